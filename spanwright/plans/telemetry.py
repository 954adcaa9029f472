"""Queries of the telemetry family over the monitors of served models."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions.telemetry import iso_micros
from spanwright.operators import telemetry as T
from spanwright.plans.views import oracle, rounded, view


def _steps(spark, sf_dir):
    """Steps, each once, with their time; null where the timestamp is missing or unreadable."""
    return view(spark, sf_dir, "step_views").dropDuplicates(["step_key"]).withColumn("us", iso_micros(F.col("step_timestamp")))


def q_a13_gpu_frame(spark, sf_dir):
    frame = T.gpu_frame(view(spark, sf_dir, "gpu_log"))
    return frame.groupBy("endpoint").agg(F.count("*").alias("samples"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count_if("failed").alias("failed"))


def q_f02_rate(spark, sf_dir):
    return rounded(T.counter_rates(T.metrics_frame(view(spark, sf_dir, "vllm_metrics"))), 6)


def q_f03_holes(spark, sf_dir):
    return T.sampling_holes(T.gpu_frame(view(spark, sf_dir, "gpu_log")), view(spark, sf_dir, "serve_endpoints"))


def q_f01_step_delta(spark, sf_dir):
    return rounded(T.step_deltas(_steps(spark, sf_dir)).select("trial_id", "step_id", "step_key", "delta_sec"), 6)


def q_c31_kv_verdict(spark, sf_dir):
    rows = T.metrics_frame(view(spark, sf_dir, "vllm_metrics")).where(F.col("error").isNull())
    return rows.groupBy("verdict", T.kv_verdict(F.col("kv_used_frac"), F.col("waiting"), F.col("running")).alias("computed")).agg(F.count("*").alias("n"))


def _windows(spark, sf_dir):
    """The time that each trial spent at an endpoint, padded by 30 seconds."""
    return _steps(spark, sf_dir).where(F.col("us").isNotNull() & F.col("endpoint").isNotNull()).groupBy(F.col("trial_id").alias("window_id"), F.col("endpoint").alias("entity")).agg(
        (F.min("us") - 30_000_000).alias("from_us"), (F.max("us") + 30_000_000).alias("to_us")
    )


def _points(spark, sf_dir):
    return T.gpu_frame(view(spark, sf_dir, "gpu_log")).select(F.col("sample_id").alias("point_id"), F.col("endpoint").alias("entity"), "us")


def q_d17_samples_in_window(spark, sf_dir):
    """Samples within any trial's time at their endpoint, each once."""
    return T.in_windows(_points(spark, sf_dir), _windows(spark, sf_dir)).select("point_id").distinct()


def q_d17_uncovered_trials(spark, sf_dir):
    """Trials during which their endpoint wasn't sampled."""
    windows = _windows(spark, sf_dir)
    seen = T.in_windows(_points(spark, sf_dir), windows).select("window_id", "entity").distinct()
    return windows.join(seen, ["window_id", "entity"], "left_anti").select("window_id", "entity")


def q_c21_window_filter(spark, sf_dir):
    """Scrapes within 30 seconds of the middle day."""
    rows = T.metrics_frame(view(spark, sf_dir, "vllm_metrics"))
    start, end = 1_572_998_400_000_000 - 30_000_000, 1_573_041_600_000_000 + 30_000_000
    return rows.where(F.col("us").between(start, end)).select("metric_id")


def q_e25_wall_clock(spark, sf_dir):
    bounds = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return rounded(T.wall_clock(bounds(_steps(spark, sf_dir), "steps"), bounds(T.gpu_frame(view(spark, sf_dir, "gpu_log")), "gpu"), bounds(T.metrics_frame(view(spark, sf_dir, "vllm_metrics")), "metrics")), 6)


def q_e32_gpu_audit(spark, sf_dir):
    return rounded(T.gpu_audit(view(spark, sf_dir, "gpu_log")))


def q_e31_capture_audit(spark, sf_dir):
    """Steps lacking what a captured completion must have."""
    steps = _steps(spark, sf_dir).where(F.col("source") == "agent")
    return steps.agg(
        F.count("*").alias("captures"), F.count_if(F.coalesce("message", F.lit("")) == "").alias("no_text"), F.count_if(F.col("us").isNull()).alias("no_time"),
        F.count_if(F.col("prompt_tokens").isNull() | F.col("completion_tokens").isNull()).alias("no_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    )


def q_e23_finish_counts(spark, sf_dir):
    return view(spark, sf_dir, "traces").groupBy("status").agg(F.count("*").alias("n"))


def q_c27_trial_status(spark, sf_dir):
    """What is known of each listed run, and how it ended."""
    runs, turns = view(spark, sf_dir, "traces").groupBy("run_id").agg(F.max_by("status", "ordinal").alias("status")), view(spark, sf_dir, "turns").select("run_id").distinct().withColumn("has", F.lit(True))
    kind = F.when(F.col("status") == "error", "infra_error").when(F.col("status").isNull() | (F.col("status") == "unknown"), "incomplete").when(F.col("has"), "trajectory").otherwise("no_trajectory")
    return runs.join(turns, "run_id", "left").groupBy(kind.alias("trial_status")).agg(F.count("*").alias("n"))


def q_g02_trial_order(spark, sf_dir):
    rank = F.when(F.col("outcome") == "win", 0).when(F.col("outcome") == "loss", 1).otherwise(2)
    return view(spark, sf_dir, "traces").orderBy(rank, F.asc_nulls_last("started_at"), "run_id", "ordinal").limit(1).select("run_id", "ordinal")


_G = """g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at) AS rn,
  CASE WHEN logged_at IS NULL OR logged_at = 0 OR isnan(logged_at) THEN CASE WHEN sampled_at = 0 THEN NULL ELSE sampled_at END ELSE logged_at END AS raw FROM gpu_log) WHERE rn = 1 AND raw IS NOT NULL),
gpu AS (SELECT *, CAST(round(CASE WHEN raw > 1e11 THEN raw * 1e3 ELSE raw * 1e6 END) AS BIGINT) AS us FROM g)"""
_M = "m AS (SELECT *, epoch_us(ts) AS us FROM (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY ingested_at) AS rn FROM vllm_metrics) WHERE rn = 1)"
_ST = """sp AS (SELECT *, trim(step_timestamp) AS b FROM (SELECT *, row_number() OVER (PARTITION BY step_key ORDER BY ingested_at) AS rn FROM step_views) WHERE rn = 1),
so AS (SELECT *, TRY_CAST(regexp_replace(b, '(?:[Zz]|[+-][0-9][0-9]:?[0-9][0-9])$', '') AS TIMESTAMP) AS bare, regexp_extract(b, '([+-])([0-9][0-9]):?([0-9][0-9])$', ['s', 'h', 'm']) AS o FROM sp),
st AS (SELECT *, epoch_us(bare) - CASE WHEN o.s IN ('+', '-') THEN CASE o.s WHEN '+' THEN 1 ELSE -1 END * (TRY_CAST(o.h AS BIGINT) * 60 + TRY_CAST(o.m AS BIGINT)) * 60000000 ELSE 0 END AS us FROM so)"""
_WIN = f"{_G}, {_ST}, win AS (SELECT trial_id AS window_id, endpoint AS entity, min(us) - 30000000 AS f, max(us) + 30000000 AS t FROM st WHERE us IS NOT NULL AND endpoint IS NOT NULL GROUP BY 1, 2)"

QUERIES = {name: f for name, f in dict(globals()).items() if name.startswith("q_")}
SQL = {
    "q_a13_gpu_frame": f"WITH {_G} SELECT endpoint, count(*) AS samples, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (error IS NOT NULL) AS failed FROM gpu GROUP BY 1",
    "q_f02_rate": f"WITH {_M}, o AS (SELECT metric_id, endpoint, gen_tokens_total - lag(gen_tokens_total) OVER w AS more, (us - lag(us) OVER w) / 1e6 AS sec FROM m WHERE error IS NULL AND gen_tokens_total IS NOT NULL WINDOW w AS (PARTITION BY endpoint ORDER BY us, metric_id)) SELECT metric_id, endpoint, round(CASE WHEN more >= 0 AND sec > 0 THEN more / sec END, 6) AS tokens_per_sec FROM o",
    "q_f03_holes": f"WITH {_G}, h AS (SELECT endpoint, lag(us) OVER (PARTITION BY endpoint ORDER BY us) AS from_us, us AS to_us FROM gpu) SELECT h.endpoint, from_us, to_us FROM h JOIN serve_endpoints e ON e.endpoint = h.endpoint WHERE to_us - from_us > e.interval_sec * 4.0 * 1e6",
    "q_f01_step_delta": f"WITH {_ST} SELECT trial_id, step_id, step_key, round((us - last_value(us IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY step_id, step_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1e6, 6) AS delta_sec FROM st",
    "q_c31_kv_verdict": f"WITH {_M} SELECT verdict, CASE WHEN kv_used_frac IS NULL OR waiting IS NULL OR running IS NULL THEN NULL WHEN waiting > 0 AND kv_used_frac >= 0.90 THEN 'kv_bound' WHEN waiting > 0 AND kv_used_frac < 0.50 THEN 'upstream' WHEN kv_used_frac >= 0.95 THEN 'nearly_full' WHEN running = 0 AND NOT waiting > 0 THEN 'idle' ELSE 'healthy' END AS computed, count(*) AS n FROM m WHERE error IS NULL GROUP BY 1, 2",
    "q_d17_samples_in_window": f"WITH {_WIN} SELECT DISTINCT sample_id AS point_id FROM gpu JOIN win ON win.entity = gpu.endpoint AND us BETWEEN f AND t",
    "q_d17_uncovered_trials": f"WITH {_WIN} SELECT window_id, entity FROM win WHERE NOT EXISTS (SELECT 1 FROM gpu WHERE gpu.endpoint = win.entity AND us BETWEEN f AND t)",
    "q_c21_window_filter": f"WITH {_M} SELECT metric_id FROM m WHERE us BETWEEN 1572998370000000 AND 1573041630000000",
    "q_e25_wall_clock": f"WITH {_G}, {_M}, {_ST}, a AS (SELECT us FROM gpu UNION ALL SELECT us FROM m UNION ALL SELECT us FROM st) SELECT min(us) AS start_us, max(us) AS end_us, round((max(us) - min(us)) / 1e6, 6) AS seconds FROM a",
    "q_e32_gpu_audit": f"WITH {_G} SELECT endpoint, count(*) AS samples, round(avg(CAST(error IS NOT NULL AS INT)), 9) AS failed_share, max(gpu_util_pct) FILTER (error IS NULL AND gpu_util_pct BETWEEN 0 AND 100) AS top_util, min(us) AS first_us, max(us) AS last_us FROM gpu GROUP BY 1",
    "q_e31_capture_audit": f"WITH {_ST} SELECT count(*) AS captures, count(*) FILTER (coalesce(message, '') = '') AS no_text, count(*) FILTER (us IS NULL) AS no_time, count(*) FILTER (prompt_tokens IS NULL OR completion_tokens IS NULL) AS no_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM st WHERE source = 'agent'",
    "q_e23_finish_counts": "SELECT status, count(*) AS n FROM traces GROUP BY 1",
    "q_c27_trial_status": "WITH r AS (SELECT run_id, arg_max_null(status, ordinal) AS status FROM traces GROUP BY 1) SELECT CASE WHEN status = 'error' THEN 'infra_error' WHEN status IS NULL OR status = 'unknown' THEN 'incomplete' WHEN run_id IN (SELECT run_id FROM turns WHERE run_id IS NOT NULL) THEN 'trajectory' ELSE 'no_trajectory' END AS trial_status, count(*) AS n FROM r GROUP BY 1",
    "q_g02_trial_order": "SELECT run_id, ordinal FROM traces ORDER BY CASE outcome WHEN 'win' THEN 0 WHEN 'loss' THEN 1 ELSE 2 END, started_at NULLS LAST, run_id, ordinal LIMIT 1",
}
SQL = {name: oracle(text) for name, text in SQL.items()}
