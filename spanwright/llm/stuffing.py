"""Pages of repeated keywords, link lists or product tags instead of sentences.

One pass over the whole texts computes content and link features. Labelling rules that abstain when
unsure, and the hand verdicts, give weak labels; bagged decision trees are fitted to a bounded
sample of them, score every document, and each score is then shifted by how the spam rate of the
document's host, shrunk towards the overall rate, differs from the latter.

Defined results: null, empty and blank texts and texts of fewer than ``min_words`` words are no
spam; verdicts are the majority of a document's non-null ones, ties abstain; a document without a
url has its source as host, one without either an own host; a null id takes no part; repeated rows of
an id give one row; with no labelled rows nothing is found; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.runtime import materialize

#: Words of grammar of the languages at hand: sentences need them, keyword lists don't.
GRAMMAR = frozenset(
    (
        "the a an of to in and is was were are be been it its this that these those with on as by at from or but not no when which who if after before so because than then only "
        "while into over under about between during through both each other there here had has have did does do will would can could should may we you they he she i our your their "
        "el la los las un una de del al que y en por con para se no es como lo le su sin pero porque cuando ya más hasta "
        "les des du et est une dans pour sur pas plus qui au aux ce cette mais car même il elle nous avant après "
        "der die das den dem des und ist nicht ein eine zu mit von auf im für aber weil dass noch nach hat wir war bei"
    ).split()
)
#: Words with which goods are praised or sold.
PROMOTION = frozenset(
    (
        "affordable alternative bargain best bundle buy cheap cheapest coupon coupons deal deals discount download exclusive fast free hot instant limited login lowest "
        "new offer offers official online order original plan premium price prices pro promo purchase rental review reviews sale sales save shipping shop stock today top trial trusted wholesale "
        "barato comprar oferta precio gratis descuento acheter cher remise gratuit prix offre promo günstig kaufen rabatt preis angebot kostenlos"
    ).split()
)
WORD = re.compile(r"[^\W\d_]\w*|\d+(?:[.,]\d+)*")
URL = re.compile(r"https?://[^\s\"'<>)\]]+", re.I)
TAG = re.compile(r"(?<!\S)#\w{2,}")
#: What parts a text into chunks, or ends a sentence. Each pattern begins with one set of characters, which lets a search
#: skip words; texts without a dash or star need not stop at blanks either, and part the same.
_SEPARATORS = r",;|•·»/\n\r\t、，"
_PARTED = rf"(?<=[{_SEPARATORS}])(?:[{_SEPARATORS}]|\s[-–—*]\s)*|(?<=[.!?])[.!?]*(?:\s|$)|(?<=[。！？])[。！？]*"
PARTS = re.compile(rf"([{_SEPARATORS}.!?。！？](?:{_PARTED}))")
PARTS_OR_DASHES = re.compile(rf"([{_SEPARATORS}.!?。！？\s](?:{_PARTED}|(?<=\s)[-–—*]\s(?:[{_SEPARATORS}]|\s[-–—*]\s)*))")
DASHES = "-–—*"
CODE_MARKS = "{}()[]=_<>"
PRICE = re.compile(r"(?<![\w.])\d{1,5}[.,]\d\d(?![\w.])")
CAPITAL = re.compile(r"[A-ZÀ-ÞА-ЯΑ-Ω]+")
ANCHOR = re.compile(r"\[([^\]\n\[]{1,80})\]\(|<a [^<>]{0,300}>([^<]{1,80})</a>")
FEATURES = (
    "log_words url_share urls_per_word tags_per_word grammar promotion top_word distinct_root bigram_repeats sentence_share "
    "short_chunks keyword_chunks words_per_chunk code_marks digits prices line_repeats bullets title_case foreign_letters chunk_repeats anchored_words promo_chunks stuffed_sentences plain_sentences"
).split()
FEATURE_SCHEMA = "doc_id bigint, host string, words bigint, features array<float>"


@dataclass(frozen=True)
class StuffingModel:
    """Parameters; ``sample_rows`` bounds the labelled rows that the trees are fitted to."""

    sample_rows: int = 12_000
    trees: int = 40
    depth: int = 7
    leaf: int = 4
    seed: int = 7
    verdict_weight: float = 3.0
    host_prior: float = 30.0
    host_pull: float = 0.25
    min_words: int = 8
    threshold: float = 0.5


def _has_code(chunk: str) -> bool:
    return not _CODE_SET.isdisjoint(chunk) or "::" in chunk or "->" in chunk


_CODE_SET = frozenset(CODE_MARKS)
_ENDS = frozenset(".!?。！？")
_WIDE_ENDS = frozenset("。！？")


def page_features(text: str) -> tuple[int, list[float]]:
    """Number of words, an address counting as three, and the features in the order of ``FEATURES``."""
    size = max(len(text), 1)
    urls = URL.findall(text) if "://" in text else []
    plain = URL.sub(" ", text) if urls else text
    is_grammar = GRAMMAR.__contains__
    find = WORD.findall
    words: list[str] = []
    chunks = short = keyword = promo_chunks = sentences = stuffed = sentence_chars = plain_chars = 0
    seen: set[str] = set()
    begin = length = 0  # where the sentence begins among the words; its characters
    low = plain.lower()
    parts = (PARTS_OR_DASHES if any(map(low.__contains__, DASHES)) else PARTS).split(low)
    parts.append("")
    for i in range(0, len(parts) - 1, 2):
        chunk, end = parts[i], parts[i + 1]
        length += len(chunk) + len(end)
        w = chunk.split() if chunk.replace(" ", "").isalpha() else find(chunk)  # letters and blanks only: the same words
        if w:
            chunks += 1
            words += w
            seen.add(chunk.strip())
            if len(w) <= 5:
                short += 1
                if GRAMMAR.isdisjoint(w) and not _has_code(chunk):
                    keyword += len(w)
                    promo_chunks += not PROMOTION.isdisjoint(w)
        if not end:
            continue
        mark = end[0]
        if mark in _ENDS:
            n = len(words) - begin
            if n >= 4:
                sentences += 1
                sentence = words[begin:]
                repeats = False
                if n <= 24 and len(set(sentence)) < n:
                    own = [x for x in sentence if len(x) > 2 and x not in GRAMMAR]
                    repeats = len(set(own)) < len(own)
                    stuffed += repeats
                if mark in _WIDE_ENDS or sum(map(is_grammar, sentence)) >= 0.1 * n:
                    sentence_chars += length
                    plain_chars += 0 if repeats else length
            elif length > 8 and mark in _WIDE_ENDS:
                sentence_chars += length  # a script without blanks
                plain_chars += length
        elif "\n" not in end:
            continue
        begin, length = len(words), 0
    n = len(words)
    d = max(n, 1)
    counts = Counter(words)
    grammar = promotion = digits = foreign = top = 0
    for w, c in counts.items():
        if w in GRAMMAR:
            grammar += c
        elif c > top and len(w) > 2:
            top = c
        if w in PROMOTION:
            promotion += c
        if not w.isascii():
            foreign += c
        elif w[0] <= "9":
            digits += c
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    k = max(chunks, 1)
    row = [
        math.log1p(n),
        sum(map(len, urls)) / size,
        len(urls) / d,
        len(TAG.findall(plain)) / d if "#" in plain else 0.0,
        grammar / d,
        promotion / d,
        top / d,
        len(counts) / math.sqrt(d),
        1 - len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 0.0,
        sentence_chars / max(len(plain), 1),
        short / k,
        keyword / d,
        min(n / k, 60.0),
        (sum(map(plain.count, CODE_MARKS)) + plain.count("::") + plain.count("->")) / size,
        digits / d,
        len(PRICE.findall(plain)) / d if digits else 0.0,
        1 - len(set(lines)) / max(len(lines), 1),
        len([x for x in lines if x[0] in "-*•1<" and (x[0] in "-*•" or x[:2] == "1." or x[:3] == "<li")]) / max(len(lines), 1),
        len(CAPITAL.findall(plain)) / d,
        foreign / d,
        1 - len(seen) / k,
        sum(len(find(x or y)) for x, y in ANCHOR.findall(plain)) / d if "](" in plain or "<a " in plain else 0.0,
        promo_chunks / k,
        stuffed / max(sentences, 1),
        plain_chars / max(len(plain), 1),
    ]
    return n + 3 * len(urls), row


def labelling_rules(x: np.ndarray) -> np.ndarray:
    """Weak labels of feature rows: 1 spam, 0 not, -1 undecided."""
    f = {name: x[:, i] for i, name in enumerate(FEATURES)}
    prose = f["sentence_share"]
    spam = (
        ((f["url_share"] > 0.5) & (prose < 0.15))
        | ((f["tags_per_word"] > 0.5) & (prose < 0.2))
        | ((f["promo_chunks"] > 0.5) & (prose < 0.2))
        | ((f["top_word"] > 0.12) & (f["bigram_repeats"] > 0.6) & (prose < 0.15) & (f["code_marks"] < 0.01) & (f["grammar"] < 0.2))
        | ((f["stuffed_sentences"] > 0.75) & (f["top_word"] > 0.12) & (f["code_marks"] < 0.01))
        | ((f["keyword_chunks"] > 0.75) & (f["promotion"] > 0.15) & (prose < 0.2) & (f["code_marks"] < 0.01))
        # nothing but names: no grammar, no sentence, no code, no figures
        | ((f["log_words"] > 2.8) & (f["grammar"] < 0.03) & (prose < 0.05) & (f["code_marks"] < 0.003) & (f["digits"] < 0.08) & (f["foreign_letters"] < 0.3))
    )
    fine = (
        (f["plain_sentences"] > 0.5)
        | ((prose > 0.55) & (f["stuffed_sentences"] < 0.5) & (f["tags_per_word"] < 0.1))
        | ((f["code_marks"] > 0.02) & (f["url_share"] < 0.1) & (f["promotion"] < 0.05))
        | ((f["line_repeats"] > 0.3) & (prose > 0.4) & (f["promotion"] < 0.05))
        | ((f["promotion"] < 0.01) & (f["url_share"] < 0.05) & (f["tags_per_word"] < 0.02) & (f["top_word"] < 0.08) & ((f["grammar"] > 0.05) | (f["code_marks"] > 0.005) | (f["digits"] > 0.08)))
    )
    return np.where(spam & ~fine, 1, np.where(fine & ~spam, 0, -1))


class BaggedTrees:
    """Decision trees on bootstrap samples, split by weighted Gini impurity; their mean leaf rate is the score."""

    def __init__(self, trees: int, depth: int, leaf: int, seed: int):
        self.count, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.nodes: list[list[tuple[int, float, int, int, float]]] = []  # (feature or -1, threshold, left, right, rate)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> BaggedTrees:
        rng = np.random.default_rng(self.seed)
        # leaves larger than half the rarer class could never hold it apart
        self.leaf = max(1, min(self.leaf, int(min(y.sum(), len(y) - y.sum())) // 2))
        for _ in range(self.count):
            rows = rng.integers(0, len(y), len(y))
            self.nodes.append([])
            self._grow(x[rows], y[rows].astype(float), w[rows], 0, rng)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, level: int, rng: np.random.Generator) -> int:
        nodes = self.nodes[-1]
        at = len(nodes)
        rate = float((w @ y + 0.02) / (w.sum() + 0.04))
        nodes.append((-1, 0.0, -1, -1, rate))
        if level >= self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        total, spam = w.sum(), w @ y
        whole = 2 * spam * (total - spam) / total
        for j in rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False):
            order = np.argsort(x[:, j], kind="stable")
            v, cw, cs = x[order, j], np.cumsum(w[order]), np.cumsum((w * y)[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= self.leaf) & (len(y) - cut - 1 >= self.leaf)]
            if not cut.size:
                continue
            lw, ls = cw[cut], cs[cut]
            rw, rs = total - lw, spam - ls
            gain = whole - 2 * ls * (lw - ls) / lw - 2 * rs * (rw - rs) / rw
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(j), float(v[cut[i]] + v[cut[i] + 1]) / 2)
        if best[1] < 0:
            return at
        go = x[:, best[1]] <= best[2]
        left = self._grow(x[go], y[go], w[go], level + 1, rng)
        right = self._grow(x[~go], y[~go], w[~go], level + 1, rng)
        nodes[at] = (best[1], best[2], left, right, rate)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.nodes:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for tree in self.nodes:
            feature, threshold, left, right, rate = (np.array(c) for c in zip(*tree))
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = feature[at] >= 0
                go = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += rate[at]
        return total / len(self.nodes)


def _host() -> Column:
    named = F.regexp_extract(F.coalesce(F.lower("url"), F.lit("")), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.col("source"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")))


def document_features(documents: DataFrame) -> DataFrame:
    """One row per document with its features (see ``FEATURE_SCHEMA``)."""
    narrow = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), _host().alias("host"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_features(t) for t in batch.column(2).to_pylist()]
            flat = np.array([x for _, x in found], np.float32).ravel()
            ends = pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat, pa.float32()))],
                names=["doc_id", "host", "words", "features"],
            )

    return narrow.mapInArrow(work, FEATURE_SCHEMA)


def _fit(features: DataFrame, reviews: DataFrame, model: StuffingModel) -> BaggedTrees:
    """Trees on a bounded sample: documents with a hand verdict first, then others in the order of a hash of their id."""
    votes = reviews.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.count_if(F.col("verdict") == "spam") - F.count_if(F.col("verdict") == "ok")).alias("vote"))
    own = features.where(F.col("words") >= model.min_words)
    half = model.sample_rows // 2
    hand = own.join(votes.where(F.col("vote") != 0), "doc_id").select("features", (F.col("vote") > 0).cast("int").alias("label"), F.xxhash64("doc_id").alias("h")).orderBy("h").limit(half)
    rest = own.join(votes.where(F.col("vote") != 0), "doc_id", "left_anti").select("features", F.lit(-1).alias("label"), F.xxhash64("doc_id").alias("h")).orderBy("h").limit(half)
    sample = hand.unionByName(rest).toArrow()
    trees = BaggedTrees(model.trees, model.depth, model.leaf, model.seed)
    if not sample.num_rows:
        return trees
    x = sample.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(float)
    hand_label = sample.column("label").to_numpy()
    by_rule = labelling_rules(x)
    y = np.where(hand_label >= 0, hand_label, by_rule)
    w = np.where(hand_label >= 0, model.verdict_weight, 1.0)
    known = y >= 0
    order = np.lexsort((*x[known].T, y[known]))  # the collected order isn't fixed; the bootstrap draws by position
    return trees.fit(x[known][order], y[known][order], w[known][order])


def scored_documents(documents: DataFrame, reviews: DataFrame, model: StuffingModel = StuffingModel()) -> DataFrame:
    """One row per document with a text: (doc_id, host, page_score, host_rate, score)."""
    features = materialize(document_features(documents), "pages")
    trees = _fit(features, reviews, model)
    least = model.min_words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(float)
            score = np.where(batch.column(2).to_numpy(zero_copy_only=False) >= least, trees.score(x), 0.0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["doc_id", "host", "page_score"])

    pages = features.mapInArrow(work, "doc_id bigint, host string, page_score double").groupBy("doc_id").agg(F.max_by("host", "page_score").alias("host"), F.max("page_score").alias("page_score"))
    pages = materialize(pages, "scores")
    by_host = pages.groupBy("host").agg(F.sum("page_score").alias("spam"), F.count("*").alias("n"))
    overall = pages.agg(F.coalesce(F.avg("page_score"), F.lit(0.0)).alias("rate")).first().rate
    base = min(max(overall, 1e-4), 1 - 1e-4)
    rates = by_host.select("host", ((F.col("spam") + model.host_prior * base) / (F.col("n") + model.host_prior)).alias("host_rate"))
    # a hot host is joined in 16 parts, should the rates be too many to broadcast
    salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    joined = pages.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(salted, ["host", "salt"], "left")
    odds = lambda p: F.log(p / (1 - p))
    sure = F.least(F.greatest(F.col("page_score"), F.lit(1e-4)), F.lit(1 - 1e-4))
    shifted = odds(sure) + F.lit(model.host_pull) * (odds(F.col("host_rate")) - F.lit(float(np.log(base / (1 - base)))))
    return joined.select("doc_id", "host", "page_score", "host_rate", (1 / (1 + F.exp(-shifted))).alias("score"))


def stuffed_pages(documents: DataFrame, reviews: DataFrame, model: StuffingModel = StuffingModel()) -> DataFrame:
    """The documents found to be spam: (doc_id, score)."""
    return scored_documents(documents, reviews, model).where(F.col("score") >= model.threshold).select("doc_id", "score")
