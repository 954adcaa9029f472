"""Memory is bounded by what its source has, not by what it used most of the day."""

from spanwright.operators.grid import regular_grid

SCHEMA = "sample_id bigint, endpoint string, logged_at double, sampled_at double, gpu_util_pct double, mem_used_mib double, mem_total_mib double, error string"
START = 86_400 * 100


def test_a_model_loaded_late_in_an_idle_day_is_kept(spark):
    slots = [s for s in range(1000) if s != 990]
    rows = [(s, "a", START + 60.0 * s, None, 50.0, 500.0 if s < 970 else 60_000.0, 80_000.0, None) for s in slots]
    found = {r.slot: r for r in regular_grid(spark.createDataFrame(rows, SCHEMA)).collect()}
    filled = found[START + 60 * 990]
    assert filled.missing and 50_000 < filled.mem_used_mib <= 80_000


def test_readings_above_the_memory_are_bounded(spark):
    rows = [(s, "a", START + 60.0 * s, None, 50.0, 1e9, 80_000.0, None) for s in (0, 1, 3)]
    found = {r.slot: r for r in regular_grid(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[START + 120].missing and found[START + 120].mem_used_mib <= 80_000


def test_sparse_sources_are_filled_in_bounded_slabs():
    """A reading every two hours leaves 119 slots of 120 to fill; no slab holds more cells than its bound."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from spanwright.operators import grid

    days, per_day = 400, 12
    slot = np.repeat(np.arange(days) * 86_400, per_day) + np.tile(np.arange(per_day) * 7200, days)
    table = pa.table({"endpoint": ["a"] * slot.size, "chunk": slot // 86_400, "slot": slot, "n": np.ones(slot.size, np.int64), "at": slot + 1.0, "top": np.full(slot.size, np.nan), "gpu_util_pct": np.full(slot.size, 5.0), "mem_used_mib": np.full(slot.size, 9.0)})
    tracemalloc.start()
    parts = [(p.num_rows, p.column("missing").to_pylist().count(True)) for p in grid._smooth(table, 60, 86_400)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) > 1 and max(n for n, _ in parts) <= grid.CELLS
    assert sum(n for n, _ in parts) == days * (per_day + 11 * 119) and sum(m for _, m in parts) == days * 11 * 119
    assert peak < 400e6
