"""Streaming forms of the telemetry and support operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanwright.functions.telemetry import sample_micros
from spanwright.runtime import scratch


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A recorded table, one file or a folder of them, as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern, as a stream's path may not be a file


def drained(stream: DataFrame, mode: str = "append", batch: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there and read its result as a table.

    Result and checkpoint are kept in the shared folder; a restarted run goes on where it stopped.
    In ``complete`` and ``update`` mode the last batch's table holds.
    """
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{base}/out")
    else:
        writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def minute_means(gpu: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Means of the samples of each endpoint by minute of event time, repeated deliveries once within the watermark."""
    timed = gpu.withColumn("at", F.timestamp_micros(sample_micros(F.col("logged_at"), F.col("sampled_at")))).where(F.col("at").isNotNull() & F.col("error").isNull())
    once = timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["sample_id"])
    return once.groupBy("endpoint", F.window("at", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.avg("gpu_util_pct").alias("util")).select("endpoint", F.col("w.start").alias("minute"), "n", "util")


def sessions(gpu: DataFrame, gap: str = "20 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches without a silence longer than ``gap``, by endpoint: the streaming form of sampling holes."""
    timed = gpu.withColumn("at", F.timestamp_micros(sample_micros(F.col("logged_at"), F.col("sampled_at")))).where(F.col("at").isNotNull())
    return timed.withWatermark("at", late).groupBy("endpoint", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n")).select("endpoint", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def counter_rates(metrics: DataFrame) -> DataFrame:
    """Tokens a second since the scrape before, with the last scrape of each endpoint as state.

    Scrapes count in the order of their time within a batch; one older than the state is late and has no rate.
    """
    rows = metrics.where(F.col("error").isNull() & F.col("gen_tokens_total").isNotNull()).select("endpoint", "metric_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "gen_tokens_total")

    def step(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(frames)).drop_duplicates("metric_id").sort_values(["us", "metric_id"])
        last_us, last_total = state.get if state.exists else (data["us"].iloc[0], None)
        late = data["us"].to_numpy() < last_us  # behind the state: no rate, and no part in the next one
        us, total = data["us"].to_numpy()[~late], data["gen_tokens_total"].to_numpy(float)[~late]
        before_us, before = np.r_[last_us, us[:-1]], np.r_[np.nan if last_total is None else last_total, total[:-1]]
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where((us > before_us) & (total >= before), (total - before) / ((us - before_us) / 1e6), np.nan)
        rate = np.full(len(data), np.nan)
        rate[~late] = own
        if us.size:
            state.update((int(us[-1]), float(total[-1])))
        found = pd.array(rate, dtype="Float64")
        found[np.isnan(rate)] = pd.NA
        yield pd.DataFrame({"endpoint": [key[0]] * len(data), "metric_id": data["metric_id"].to_numpy(), "tokens_per_sec": found})

    return rows.groupBy("endpoint").applyInPandasWithState(step, "endpoint string, metric_id bigint, tokens_per_sec double", "us bigint, total double", "append", GroupStateTimeout.NoTimeout)


def support_counts(rollouts: DataFrame) -> DataFrame:
    """Running n and c of a log of rollouts by (model, task, stratum)."""
    return rollouts.where(F.col("passed").isNotNull()).groupBy("model", "task", "stratum").agg(F.count("*").alias("n"), F.count_if("passed").alias("c"))


def replay_once(stream: DataFrame, keys: list[str], path: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Apply ``work`` to each key of a stream once, appending to ``path``: what is there already is skipped."""
    from spanwright.sources.sinks import append_missing

    base = scratch(stream.sparkSession, "replay")
    query = stream.writeStream.foreachBatch(lambda df, n: append_missing(work(df), path, keys) and None).option("checkpointLocation", base).trigger(availableNow=True)
    query.start().awaitTermination()
