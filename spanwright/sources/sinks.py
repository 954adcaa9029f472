"""Writers: reports, resumable appends, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanwright.runtime import path_exists


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; nulls are written, since a missing rate is a fact of its own."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys aren't in the parquet table at ``path`` yet; their number. A second call appends none.

    The target is read once, by its keys; the rows are counted as they are written. One writer at a time: two calls at
    once may both append a key.
    """
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    if path_exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def content_hash(*parts: Column) -> Column:
    """SHA-256 over parts joined by zero bytes; null parts are left out."""
    joined = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\u0000")
    return F.sha2(joined, 256)


def deficit_report(scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """Scores with a short summary of the distinct evidence of each capability."""
    notes = evidence.groupBy("capability_id").agg(F.left(F.array_join(F.array_sort(F.collect_set("evidence")), " "), F.lit(800)).alias("summary"))
    return scores.join(notes, "capability_id", "left")


def drifted(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two manifests; null in both is no difference."""
    a, b = first.select(key, F.col(value).alias("a")), second.select(key, F.col(value).alias("b"))
    return a.join(b, key, "full").where(~F.col("a").eqNullSafe(F.col("b")))
