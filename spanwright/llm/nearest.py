"""Pairing records with the nearest record in time of the same entity, within a tolerance.

Both sides are cut into time ranges; a candidate within the tolerance of a range's end is copied
into the neighbouring range, a left record is in one range only. Each (entity, range) is co-grouped
and matched by binary search over the sorted candidate times, comparing the two neighbours. A hot
entity is spread over its time ranges, so no task holds more than one range of it.

Defined results: times are whole microseconds and the tolerance is inclusive; of two candidates
equally near the earlier counts, of several at one time the smallest id; records with a null
entity, time or id take no part; repeated rows count once; an empty side gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions.telemetry import iso_micros, sample_micros, spread_over_ranges

OUT_SCHEMA = "left_id bigint, side int, right_id bigint, left_us bigint, right_us bigint"


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_us: int, range_us: int = 6 * 3_600_000_000) -> DataFrame:
    """Partners of ``left`` (entity STRING, left_id BIGINT, us BIGINT) among ``right`` (entity, side INT, right_id, us).

    One row per left record and side that has a partner, at most ``tolerance_us`` away.
    """
    if range_us <= 0 or tolerance_us < 0:
        raise ValueError("the range must be positive and the tolerance not negative")
    bucket = F.floor(F.col("us") / F.lit(range_us)).cast("bigint")
    lefts = left.where(F.col("entity").isNotNull() & F.col("us").isNotNull() & F.col("left_id").isNotNull()).select("entity", bucket.alias("bucket"), "left_id", "us")
    rights = right.where(F.col("entity").isNotNull() & F.col("us").isNotNull() & F.col("right_id").isNotNull()).select(
        "entity", F.explode(spread_over_ranges(F.col("us"), range_us, tolerance_us)).alias("bucket"), F.col("side").cast("int").alias("side"), "right_id", "us"
    )

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        return _match(a, b, tolerance_us)

    return lefts.groupBy("entity", "bucket").cogroup(rights.groupBy("entity", "bucket")).applyInArrow(match, OUT_SCHEMA)


def _match(left: pa.Table, right: pa.Table, tolerance: int) -> pa.Table:
    empty = pa.table({"left_id": pa.array([], pa.int64()), "side": pa.array([], pa.int32()), "right_id": pa.array([], pa.int64()), "left_us": pa.array([], pa.int64()), "right_us": pa.array([], pa.int64())})
    if not left.num_rows or not right.num_rows:
        return empty
    ids, t = left.column("left_id").to_numpy(), left.column("us").to_numpy()
    _, first = np.unique(np.stack([ids, t]), axis=1, return_index=True)
    ids, t = ids[first], t[first]
    parts = []
    sides = right.column("side")
    for side in sorted(pc.unique(sides).to_pylist()):
        own = right.filter(pc.equal(sides, side))
        rid, rt = own.column("right_id").to_numpy(), own.column("us").to_numpy()
        order = np.lexsort((rid, rt))
        rid, rt = rid[order], rt[order]
        once = np.r_[True, rt[1:] != rt[:-1]]  # the smallest id of each time
        rid, rt = rid[once], rt[once]
        at = np.searchsorted(rt, t)
        before, after = np.maximum(at - 1, 0), np.minimum(at, rt.size - 1)
        db, da = np.abs(t - rt[before]), np.abs(rt[after] - t)
        best = np.where(db <= da, before, after)
        near = np.abs(rt[best] - t) <= tolerance
        k = int(near.sum())
        if k:
            parts.append(pa.table({"left_id": ids[near], "side": pa.array(np.full(k, side), pa.int32()), "right_id": rid[best][near], "left_us": t[near], "right_us": rt[best][near]}))
    return pa.concat_tables(parts) if parts else empty


def steps_with_telemetry(step_views: DataFrame, gpu_log: DataFrame, vllm_metrics: DataFrame, tolerance_sec: float = 30.0) -> DataFrame:
    """Partners of each step in both telemetry tables: (step_key, matched_table, matched_id, delta_us)."""
    steps = step_views.select(F.col("endpoint").alias("entity"), F.col("step_key").cast("bigint").alias("left_id"), iso_micros(F.col("step_timestamp")).alias("us"))
    gpu = gpu_log.where(F.col("error").isNull()).select(F.col("endpoint").alias("entity"), F.lit(0).alias("side"), F.col("sample_id").cast("bigint").alias("right_id"), sample_micros(F.col("logged_at"), F.col("sampled_at")).alias("us"))
    metrics = vllm_metrics.where(F.col("error").isNull()).select(F.col("endpoint").alias("entity"), F.lit(1).alias("side"), F.col("metric_id").cast("bigint").alias("right_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    pairs = nearest_in_time(steps, gpu.unionByName(metrics), int(round(tolerance_sec * 1_000_000)))
    table = F.when(F.col("side") == 0, "gpu_log").otherwise("vllm_metrics")
    return pairs.select(F.col("left_id").alias("step_key"), table.alias("matched_table"), F.col("right_id").alias("matched_id"), (F.col("right_us") - F.col("left_us")).alias("delta_us"))
