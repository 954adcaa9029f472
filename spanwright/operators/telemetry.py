"""Telemetry of serving: frames, rates, sampling holes, interval joins, verdicts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.telemetry import sample_micros


def gpu_frame(gpu_log: DataFrame) -> DataFrame:
    """Samples that have a time, each once: (sample_id, endpoint, us, gpu_util_pct, mem_used_mib, power_w, failed)."""
    timed = gpu_log.select("sample_id", "endpoint", sample_micros(F.col("logged_at"), F.col("sampled_at")).alias("us"), "gpu_util_pct", "mem_used_mib", "power_w", F.col("error").isNotNull().alias("failed"))
    return timed.where(F.col("us").isNotNull()).dropDuplicates(["sample_id"])


def metrics_frame(vllm_metrics: DataFrame) -> DataFrame:
    """Scrapes, each once, with their time in microseconds."""
    return vllm_metrics.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).dropDuplicates(["metric_id"])


def counter_rates(metrics: DataFrame) -> DataFrame:
    """Tokens a second since the scrape before; null after a restart or where time didn't advance.

    The window is by endpoint and day, so that a hot endpoint is spread; the last scrape of the day
    before is handed over as the first row's predecessor.
    """
    day = F.floor(F.col("us") / F.lit(86_400_000_000)).cast("bigint")
    rows = metrics.where(F.col("error").isNull() & F.col("gen_tokens_total").isNotNull()).select("metric_id", "endpoint", "us", "gen_tokens_total", day.alias("day"))
    edges = rows.groupBy("endpoint", "day").agg(F.max(F.struct("us", "metric_id", "gen_tokens_total")).alias("last"))
    by_day = Window.partitionBy("endpoint").orderBy("day")  # one row a day
    handed = edges.select("endpoint", "day", F.lag("last").over(by_day).alias("handed"))
    order = Window.partitionBy("endpoint", "day").orderBy("us", "metric_id")
    with_prev = rows.join(handed, ["endpoint", "day"]).withColumns(
        {"p_us": F.coalesce(F.lag("us").over(order), F.col("handed.us")), "p_total": F.coalesce(F.lag("gen_tokens_total").over(order), F.col("handed.gen_tokens_total"))}
    )
    more, seconds = F.col("gen_tokens_total") - F.col("p_total"), (F.col("us") - F.col("p_us")) / 1e6
    return with_prev.select("metric_id", "endpoint", F.when((more >= 0) & (seconds > 0), more / seconds).alias("tokens_per_sec"))


def sampling_holes(frame: DataFrame, endpoints: DataFrame, factor: float = 4.0) -> DataFrame:
    """Silences longer than ``factor`` sampling intervals: (endpoint, from_us, to_us)."""
    day = F.floor(F.col("us") / F.lit(86_400_000_000)).cast("bigint")
    rows = frame.select("endpoint", "us", day.alias("day"))
    edges = rows.groupBy("endpoint", "day").agg(F.max("us").alias("last"))
    handed = edges.select("endpoint", "day", F.lag("last").over(Window.partitionBy("endpoint").orderBy("day")).alias("handed"))
    prev = F.coalesce(F.lag("us").over(Window.partitionBy("endpoint", "day").orderBy("us")), F.col("handed"))
    gaps = rows.join(handed, ["endpoint", "day"]).select("endpoint", prev.alias("from_us"), F.col("us").alias("to_us"))
    every = endpoints.select("endpoint", "interval_sec").dropDuplicates(["endpoint"])
    return gaps.join(every, "endpoint").where((F.col("to_us") - F.col("from_us")) > F.col("interval_sec") * factor * 1e6).select("endpoint", "from_us", "to_us")


def step_deltas(steps: DataFrame) -> DataFrame:
    """Seconds since the last earlier step of the trial that has a time: (trial_id, step_id, step_key, us)."""
    order = Window.partitionBy("trial_id").orderBy("step_id", "step_key").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("us", ignorenulls=True).over(order)
    return steps.withColumn("delta_sec", (F.col("us") - last) / 1e6)


def in_windows(points: DataFrame, windows: DataFrame, width_us: int = 3_600_000_000) -> DataFrame:
    """Pairs of points (point_id, entity, us) and closed windows (window_id, entity, from_us, to_us) that hold them.

    An equi-join on entity and hour: a window is copied into the hours that it spans.
    """
    hour = lambda c: F.floor(F.col(c) / F.lit(width_us)).cast("bigint")
    spread = windows.withColumn("hour", F.explode(F.sequence(hour("from_us"), hour("to_us"))))
    return points.withColumn("hour", hour("us")).join(spread, ["entity", "hour"]).where(F.col("us").between(F.col("from_us"), F.col("to_us"))).select("point_id", "window_id", "entity")


def kv_verdict(used: Column, waiting: Column, running: Column) -> Column:
    """What holds a server back: its cache, those who call it, or nothing; null where nothing was measured."""
    queued = waiting > 0
    return (
        F.when(used.isNull() | waiting.isNull() | running.isNull(), None)
        .when(queued & (used >= 0.90), "kv_bound")
        .when(queued & (used < 0.50), "upstream")
        .when(used >= 0.95, "nearly_full")
        .when((running == 0) & ~queued, "idle")
        .otherwise("healthy")
    )


def gpu_audit(gpu_log: DataFrame) -> DataFrame:
    """Per endpoint: samples, share that failed, highest plausible utilisation and memory, and the time covered."""
    frame = gpu_frame(gpu_log)
    fine = ~F.col("failed")
    util = F.when(fine & F.col("gpu_util_pct").between(0, 100), F.col("gpu_util_pct"))
    return frame.groupBy("endpoint").agg(
        F.count("*").alias("samples"), F.avg(F.col("failed").cast("double")).alias("failed_share"), F.max(util).alias("top_util"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )


def wall_clock(*candidates: DataFrame) -> DataFrame:
    """One row: the earliest start and latest end over all artifacts (kind, start_us, end_us) that have them."""
    every = candidates[0]
    for c in candidates[1:]:
        every = every.unionByName(c)
    return every.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), ((F.max("end_us") - F.min("start_us")) / 1e6).alias("seconds"))
