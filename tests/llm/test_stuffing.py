import random

import numpy as np
import pytest

from spanwright.llm import stuffing as S

DOCS = "doc_id bigint, text string, url string, source string, host string, score string"
REVIEWS = "doc_id bigint, verdict string, reviewer string"
GOODS = ["copper kettle", "garden hose", "wool blanket", "desk lamp"]
NOUNS = ["report", "window", "engineer", "valley", "printer", "answer", "orchard", "signal"]


def prose(rng):
    return " ".join(f"The {rng.choice(NOUNS)} was not in the {rng.choice(NOUNS)} when we asked about it on day {rng.randint(1, 99)}." for _ in range(rng.randint(5, 15)))


def log(rng):
    return "\n".join(f"tests/test_{rng.choice(NOUNS)}.py::test_{rng.choice(NOUNS)} PASSED [ {rng.randint(1, 99)}%]" for _ in range(30))


def spam(rng):
    kind = rng.randint(0, 3)
    if kind == 0:
        return ", ".join(f"{rng.choice(['cheap', 'buy', 'best'])} {rng.choice(GOODS)} {rng.choice(['deal', 'price', 'coupon'])}" for _ in range(40))
    if kind == 1:
        return "\n".join(f"https://shop{rng.randint(1, 9)}.example/{rng.choice(NOUNS)}?id={rng.randint(1, 999)}" for _ in range(30))
    if kind == 2:
        good = rng.choice(GOODS)
        return " ".join([good] * 60)
    return " ".join(f"#{rng.choice(GOODS).title().replace(' ', '')}{rng.choice(['Deal', 'Offer'])}" for _ in range(40))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    docs, truth = [], {}
    for i in range(400):
        bad = i % 5 == 0
        truth[i] = bad
        docs.append((i, spam(rng) if bad else rng.choice([prose, log])(rng), f"https://h{i % 7}.example/{i}" if i % 3 else None, f"s{i % 4}", "clash", "clash"))
    docs += [(1000, None, None, None, "x", "x"), (1001, "", None, None, "x", "x"), (1002, "  \n ", None, None, "x", "x"), (1003, "buy", None, None, "x", "x"), (None, "x", None, None, "x", "x"), docs[0], docs[1]]
    reviews = [(i, "spam" if truth[i] else "ok", "r") for i in range(0, 120)] + [(5, None, "r"), (None, "ok", "r"), (7, "spam", "q")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(reviews, REVIEWS), truth


def test_held_out_accuracy(spark, tables):
    docs, reviews, truth = tables
    found = [r.doc_id for r in S.stuffed_pages(docs, reviews).collect()]
    assert len(found) == len(set(found))
    held = [i for i in truth if i >= 120]
    right = sum((i in set(found)) == truth[i] for i in held)
    assert right / len(held) > 0.97
    assert not {1000, 1001, 1002, 1003} & set(found)


def test_scores_are_one_per_document(spark, tables):
    docs, reviews, _ = tables
    rows = S.scored_documents(docs, reviews).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 403
    assert all(0 <= r.score <= 1 for r in rows)


def test_empty(spark, tables):
    docs, reviews, _ = tables
    assert S.stuffed_pages(spark.createDataFrame([], DOCS), reviews).count() == 0
    assert S.scored_documents(docs, spark.createDataFrame([], REVIEWS)).count() == 403


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((600, 5))
    y = ((x[:, 1] > 0.6) | (x[:, 3] < 0.1)).astype(int)
    trees = S.BaggedTrees(15, 6, 3, 1).fit(x[:400], y[:400], np.ones(400))
    assert ((trees.score(x[400:]) > 0.5) == y[400:]).mean() > 0.95
    assert S.BaggedTrees(3, 3, 1, 1).score(x).tolist() == [0.0] * 600


def test_features_take_any_text():
    for text in ("", " ", "\x00" * 50, "." * 20_000, "a" * 100_000, "a," * 50_000, "https://" * 2000, "[" * 5000, "<a " * 3000, "。" * 100, "#" * 999):
        n, row = S.page_features(text)
        assert len(row) == len(S.FEATURES) and all(np.isfinite(row)) and n >= 0
