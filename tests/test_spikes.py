import math
import random

import pytest

from spanwright.operators.spikes import implausible_values

SCHEMA = "sample_id bigint, endpoint string, logged_at double, sampled_at double, gpu_util_pct double, mem_util_pct double, mem_used_mib double, mem_total_mib double, temperature_c double, power_w double, error string, ingested_at string, kind string"
LIMITS = "endpoint string, mem_total_mib int, power_limit_w double"


def series(endpoint, start, n, seed, moving=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        busy = (i // 40) % 2 == 1
        u = float(min(100, max(0, rng.gauss(65, 8)))) // 1 if busy else 0.0
        p = 35 + rng.gauss(0, 1) if u < 5 else 95 + 2.2 * u + rng.gauss(0, 4)
        m = 25_000 + rng.gauss(0, 500) // 1 if moving else 40_000.0
        rows.append([start + i, endpoint, 1.57e9 + i * 10 + rng.random(), None, u, u * 0.6, float(m), 46_068.0, 34 + 0.45 * u + rng.gauss(0, 1), p, None, "x", "clash"])
    return rows


@pytest.fixture(scope="module")
def found(spark):
    a, b = series("a", 0, 800, 1), series("b", 10_000, 800, 2, moving=False)
    a[100][9] = 900.0  # beyond what the GPU may draw
    a[150][4] = 101.0
    a[200][6] = 900.0  # a drop for one sample
    a[201][4] = math.nan
    for i in range(300, 320):
        a[i][9] = 140.25  # stuck across a change of load
    a[310][9] = None  # neither a case nor a break
    b[500][6] = 46_000.0
    b[600][2], b[600][3], b[600][4] = None, None, 250.0  # no time at all
    b[601][10], b[601][4] = "failed", 999.0
    rows = a + b + [list(a[100])] + [list(a[300])]
    rows.append([None, None, None, None, None, None, None, None, None, None, None, None, None])
    log = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    limits = spark.createDataFrame([("a", 46_068, 350.0), ("b", 46_068, 350.0)], LIMITS)
    return {(r.sample_id, r.field): r.kind for r in implausible_values(log, limits).collect()}, implausible_values(log, limits).count()


def test_each_kind(found):
    rows, count = found
    assert count == len(rows), "a repeated delivery counts once"
    assert rows[(100, "power_w")] == "range" and rows[(150, "gpu_util_pct")] == "range"
    assert rows[(200, "mem_used_mib")] == "spike" and rows[(10_500, "mem_used_mib")] == "spike"
    stuck = {k for k, v in rows.items() if v == "stuck"}
    assert stuck == {(i, "power_w") for i in range(300, 320) if i != 310}, "the first member included, nulls not"
    assert rows[(10_600, "gpu_util_pct")] == "range", "a sample without a time is held to the bounds"
    assert not any(k[0] in (201, 10_601) and k[1] == "gpu_util_pct" for k in rows)


def test_nothing_else(found):
    rows, _ = found
    expected = {(100, "power_w"), (150, "gpu_util_pct"), (200, "mem_used_mib"), (10_500, "mem_used_mib"), (10_600, "gpu_util_pct")} | {(i, "power_w") for i in range(300, 320) if i != 310}
    assert set(rows) == expected


def test_empty(spark):
    assert implausible_values(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_loading_after_a_silence_is_normal(spark):
    rows = series("a", 0, 400, 3, moving=False)
    for i in range(200, 400):
        rows[i][2] += 4_000
    for k, v in enumerate((500.0, 8_000.0, 16_000.0, 24_000.0, 32_000.0)):
        rows[200 + k][6] = v
    found = implausible_values(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), None).collect()
    assert [r for r in found if r.field == "mem_used_mib"] == []
