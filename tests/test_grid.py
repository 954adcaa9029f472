import math

from spanwright.operators.grid import regular_grid

SCHEMA = "sample_id bigint, endpoint string, logged_at double, sampled_at double, gpu_util_pct double, mem_used_mib double, error string, slot string, ingested_at string"
DAY = 86_400


def row(i, t, u=50.0, m=1000.0, endpoint="a", error=None, sampled=None):
    return (i, endpoint, t, sampled, u, m, error, "clash", "x")


def grid(spark, rows):
    return {(r.endpoint, r.slot): r for r in regular_grid(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_fills_between_readings_across_midnight(spark):
    start = DAY * 100 - 150.0
    rows = [row(1, start, 10.0), row(1, start, 10.0), row(2, start + 600, 40.0), row(3, start + 601, 44.0)]
    found = grid(spark, rows)
    first, last = int(start) // 60 * 60, int(start + 600) // 60 * 60
    assert set(found) == {("a", s) for s in range(first, last + 60, 60)}
    missing = [s for (_, s), r in found.items() if r.missing]
    assert sorted(missing) == list(range(first + 60, last, 60))
    assert found[("a", first)].gpu_util_pct == 10.0 and found[("a", first)].n_samples == 1
    assert found[("a", last)].gpu_util_pct == 42.0 and found[("a", last)].n_samples == 2
    for s in missing:
        r = found[("a", s)]
        assert 0 <= r.gpu_util_pct <= 100 and r.gpu_util_pct_sd > found[("a", first)].gpu_util_pct_sd * 0.5
        assert 5 <= r.gpu_util_pct <= 60 and not math.isnan(r.mem_used_mib)


def test_long_silences_are_stops(spark):
    rows = [row(1, 60.0), row(2, 60.0 + DAY), row(3, 60.0 + DAY + 120)]
    found = grid(spark, rows)
    assert {s for _, s in found} == {60, 60 + DAY, 120 + DAY, 180 + DAY}
    almost = grid(spark, [row(1, 60.0), row(2, float(DAY))])
    assert len(almost) == (DAY - 60) // 60 + 1


def test_unusable_samples(spark):
    rows = [row(1, 60.0), row(2, 120.0, u=math.nan), row(3, 180.0, m=None), row(4, 240.0, error="x"), row(5, None, sampled=300.0), row(6, None), row(7, 0.0, sampled=0.0)]
    found = grid(spark, rows)
    assert {s for (_, s), r in found.items() if not r.missing} == {60, 300}
    assert {s for (_, s), r in found.items() if r.missing} == {120, 180, 240}


def test_milliseconds_and_null_endpoints(spark):
    found = grid(spark, [row(1, 1.5e12, endpoint=None), row(2, 1.5e9 + 120, endpoint=None)])
    assert len(found) == 3 and all(e is None for e, _ in found)


def test_empty(spark):
    assert grid(spark, []) == {}
