"""Queries of the measurement operators: implausible values (p2) and the regular grid (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators.grid import regular_grid
from spanwright.operators.spikes import implausible_values
from spanwright.runtime import read_table


def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every implausible value with its kind and probability."""
    return implausible_values(read_table(spark, sf_dir, "gpu_log"), read_table(spark, sf_dir, "serve_endpoints"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_flags(spark, sf_dir).select("sample_id", "field")


def p6_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid: readings and filled slots with their uncertainty."""
    return regular_grid(read_table(spark, sf_dir, "gpu_log"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_grid(spark, sf_dir).where(F.col("missing")).select("endpoint", "slot")


P6_FOUND_SQL = """
WITH timed AS (
  SELECT DISTINCT ON (sample_id) sample_id, endpoint, gpu_util_pct, mem_used_mib,
         CASE WHEN logged_at IS NULL OR logged_at = 0 OR isnan(logged_at) THEN sampled_at ELSE logged_at END AS raw
  FROM gpu_log WHERE error IS NULL),
usable AS (
  SELECT DISTINCT endpoint,
         CAST(floor(round(CASE WHEN raw > 1e11 THEN raw * 1e3 ELSE raw * 1e6 END) / 60000000) AS BIGINT) * 60 AS slot
  FROM timed
  WHERE raw IS NOT NULL AND raw <> 0 AND NOT isnan(raw)
    AND gpu_util_pct IS NOT NULL AND NOT isnan(gpu_util_pct) AND mem_used_mib IS NOT NULL AND NOT isnan(mem_used_mib)),
gaps AS (SELECT endpoint, slot, lead(slot) OVER (PARTITION BY endpoint ORDER BY slot) AS next_slot FROM usable)
SELECT endpoint, CAST(unnest(range(slot + 60, next_slot, 60)) AS BIGINT) AS slot
FROM gaps WHERE next_slot - slot > 60 AND next_slot - slot < 86400
"""

QUERIES = {"p2_found": p2_found, "p2_flags": p2_flags, "p6_found": p6_found, "p6_grid": p6_grid}
SQL = {"p6_found": P6_FOUND_SQL}
