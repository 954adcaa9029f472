import os
import random

import pytest

from spanwright.llm.automaton import TokenAutomaton
from spanwright.llm.packing import pack
from spanwright.llm.tokens import DEFAULT_TOKENIZER, decode_ids, encode_texts, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_TOKENIZER), reason="no vocabulary files")
SCHEMA = "doc_id bigint, text string, source string, ids string, n_tokens int"
PIECES = ["aaa", "the", "ing", " ", "  ", "\n", "é", "日本", "😀", "\u0301", "ab", "1", "23", "'s", "_", "--", "AAAA", "x" * 40, "\u200d", "<|endoftext|>", "\r\n", "\x00", "\ufeff"]


@pytest.fixture(scope="module")
def automaton():
    with open(DEFAULT_TOKENIZER, "rb") as f:
        return TokenAutomaton(f.read())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_equals_the_merges(automaton, reference):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(40)) for _ in range(1000)]
    texts += ["a" * 3000, " " * 3000, "ab" * 2000, "=-" * 1500, ""]
    expected = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [automaton.encode(t) for t in texts] == expected
    assert all(automaton.decode(ids) == t for ids, t in zip(expected, texts))


def test_every_pair_of_a_path_is_an_arc(automaton):
    ids = automaton.encode("Understanding tokenisation: antidisestablishmentarianism 12345")
    word = automaton.encode_word(b"antidisestablishmentarianism")
    assert len(ids) > 5 and all(automaton.follows(a, b) for a, b in zip(word, word[1:]))


def test_defined_results(spark):
    data = [(1, "hello world", "a", "clash", 1), (2, "", "a", "x", 1), (3, None, None, "x", 1), (None, "hi", "a", "x", 1), (1, "hello world", "a", "x", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    rows = sorted((str(r.doc_id), list(r.ids)) for r in encode_texts(df).collect())
    assert rows == sorted([("1", [31373, 995]), ("1", [31373, 995]), ("2", []), ("3", []), ("None", [5303])])
    assert sorted(r.n_tokens for r in token_counts(df, "doc_id", "text", ("source",)).collect()) == [1, 2, 2]
    assert encode_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.text for r in decode_ids(encode_texts(df)).collect()} == {"hello world", "", "hi"}


ITEMS = "item_id bigint, source string, n_tokens bigint, lane string"


@pytest.mark.parametrize("lane_items", [50_000, 40])
def test_packing_is_whole(spark, lane_items):
    rng = random.Random(1)
    items = [(i, rng.choice(["hot", "hot", "b", "c", None]), min(1 + int(rng.expovariate(1 / 300)), 5000), "clash") for i in range(600)]
    items += [(900, "b", 4096, "x"), (901, "b", 2048, "x"), (902, None, 2049, "x"), (903, "b", 0, "x"), (904, "b", None, "x"), (5, items[5][1], items[5][2], "x")]
    rows = pack(spark.createDataFrame(items, ITEMS), 2048, lane_items=lane_items).collect()
    fill, parts = {}, {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.item_id, []).append(r)
    assert max(fill.values()) <= 2048
    sizes = [n for _, _, n, _ in items if n]
    assert sum(fill.values()) == sum(sizes)
    assert len(rows) == sum(-(-n // 2048) for n in sizes)
    for i, _, n, _ in items:
        if not n:
            assert i not in parts
        elif n <= 2048 and i != 5:
            assert [p.n_tokens for p in parts[i]] == [n]
    least = -(-sum(sizes) // 2048)
    assert len(fill) <= least * 1.02 + (1 if lane_items > 600 else 20)
    assert len({(r.container_id, r.position) for r in rows}) == len(rows)


def test_proportions_hold_early(spark):
    """Containers follow the mixture from the first on, rather than using up one source after another."""
    items = [(i, "a" if i % 4 else "b", 64 + i % 7, "x") for i in range(4000)]
    rows = pack(spark.createDataFrame(items, ITEMS), 2048).collect()
    ids = sorted({r.container_id for r in rows})
    half = set(ids[: len(ids) // 2])
    share = lambda keep: sum(r.n_tokens for r in rows if r.source == "b" and r.container_id in keep) / sum(r.n_tokens for r in rows if r.container_id in keep)
    assert abs(share(half) - share(set(ids))) < 0.02


def test_lanes_carry_deficits(spark):
    """Prefix sums in two levels equal the plain ones, blocks of lanes crossed."""
    from pyspark.sql import functions as F

    from spanwright.llm import packing

    rng = random.Random(3)
    data = [(lane, q, rng.randint(1, 50)) for lane in range(2600) for q in "ab" if rng.random() < 0.7]
    found = packing._before(spark.createDataFrame(data, "lane int, queue string, tokens long"), "queue", "tokens", "had")
    sums, expected = {"a": 0, "b": 0}, {}
    for lane, q, n in data:
        expected[lane, q] = sums[q]
        sums[q] += n
    assert {(r.lane, r.queue): r.had for r in found.collect()} == expected
    one = packing._before(spark.createDataFrame(data, "lane int, queue string, tokens long").groupBy("lane").agg(F.sum("tokens").alias("t")), None, "t", "before")
    assert one.orderBy(F.desc("lane")).first().before == sum(n for lane, _, n in data if lane < max(x for x, _, _ in data))


def test_packing_nothing(spark):
    assert pack(spark.createDataFrame([], ITEMS)).count() == 0


def test_target_shares(spark):
    """Containers follow the shares asked for until a source runs out, and no item is lost."""
    items = [(i, "a" if i % 2 else "b", 100 + i % 11, "x") for i in range(3000)]
    shares = spark.createDataFrame([("a", 0.8), ("b", 0.2), ("unseen", 0.5)], "source string, share double")
    rows = pack(spark.createDataFrame(items, ITEMS), 2048, target_shares=shares).collect()
    assert len(rows) == 3000
    ids = sorted({r.container_id for r in rows})
    early = [r for r in rows if r.container_id in set(ids[: len(ids) // 3])]
    share = sum(r.n_tokens for r in early if r.source == "a") / sum(r.n_tokens for r in early)
    assert abs(share - 0.8) < 0.03
