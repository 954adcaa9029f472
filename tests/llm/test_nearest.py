import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from spanwright.llm.nearest import iso_micros, nearest_in_time

LEFT, RIGHT = "entity string, left_id bigint, us bigint, bucket string", "entity string, side int, right_id bigint, us bigint, bucket string"


def brute(left, right, tolerance):
    out = set()
    for e, i, t, _ in left:
        if e is None or i is None or t is None:
            continue
        for side in (0, 1):
            near = [(abs(u - t), u, r) for f, s, r, u, _ in right if f == e and s == side and u is not None and r is not None and abs(u - t) <= tolerance]
            if near:
                out.add((i, side, min(near)[2]))
    return out


def run(spark, left, right, tolerance, width):
    found = nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), tolerance, width)
    rows = [(r.left_id, r.side, r.right_id) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,width", [(1, 100), (2, 1000), (3, 37), (4, 10**9)])
def test_equals_brute_force(spark, seed, width):
    rng = random.Random(seed)
    hot = lambda: rng.choice(["a", "a", "a", "b", None])
    left = [(hot(), i, rng.randint(-500, 3000), "x") for i in range(200)]
    right = [(hot(), rng.randint(0, 1), i, rng.randint(-500, 3000), "x") for i in range(400)]
    left += left[:20] + [("a", 999, None, "x"), ("a", None, 5, "x")]
    right += right[:20] + [("a", 0, None, 7, "x"), ("a", 1, 7, None, "x")]
    assert run(spark, left, right, 30, width) == brute(left, right, 30)


def test_tolerance_is_inclusive_and_ties_go_to_the_earlier(spark):
    left = [("a", 1, 1000, "x")]
    assert run(spark, left, [("a", 0, 5, 970, "x"), ("a", 0, 6, 1030, "x"), ("a", 1, 7, 1031, "x")], 30, 100) == {(1, 0, 5)}
    assert run(spark, left, [("a", 0, 9, 1000, "x"), ("a", 0, 8, 1000, "x")], 0, 100) == {(1, 0, 8)}


def test_empty_sides(spark):
    assert run(spark, [], [("a", 0, 1, 1, "x")], 30, 100) == set()
    assert run(spark, [("a", 1, 1, "x")], [], 30, 100) == set()


def test_iso_renderings(spark):
    at = int(datetime(2019, 11, 5, 2, 9, 20, 15000, tzinfo=UTC).timestamp() * 1_000_000)
    good = ["2019-11-05T02:09:20.015Z", " 2019-11-05 02:09:20.015 ", "2019-11-05T02:09:20.015+00:00", "2019-11-04T19:09:20.015-07:00", "2019-11-05T07:39:20.015000+0530", "20191105T020920.015Z", "2019-11-05t02:09:20,015z"]
    bad = ["", "pending", "0000-00-00T00:00:00Z", "2019-13-01T00:00:00Z", None, "n/a", "2019-11-05"]
    rows = spark.createDataFrame([(s,) for s in good + bad], "s string").select("s", iso_micros(F.col("s")).alias("us")).collect()
    assert [r.us for r in rows] == [at] * len(good) + [None] * len(bad)
