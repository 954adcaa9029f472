"""Queries over streams and over the SQL surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright import streaming as S
from spanwright.functions import sql as sqlfuncs
from spanwright.plans.views import oracle, rounded, view


def q_w02_minute_means(spark, sf_dir):
    """Minutes that the watermark has closed; the last ten minutes of the stream stay open."""
    means = S.drained(S.minute_means(S.table_stream(spark, sf_dir, "gpu_log")), "append")
    return rounded(means.withColumn("minute", F.unix_seconds("minute")), 6)


def q_w02_sessions(spark, sf_dir):
    """Stretches of sampling that a silence of twenty minutes has ended, ten minutes before the stream's latest sample or earlier."""
    found = S.drained(S.sessions(S.table_stream(spark, sf_dir, "gpu_log")), "append")
    return found.groupBy("endpoint").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"), F.min(F.unix_micros("start")).alias("first_us"))


def q_w03_stream_rate(spark, sf_dir):
    return rounded(S.drained(S.counter_rates(S.table_stream(spark, sf_dir, "vllm_metrics"))), 6)


def q_w04_stream_passk(spark, sf_dir):
    """Verdict counts of a rollout log, as a stream; an event is a rollout, a purchase or click a pass."""
    events = S.table_stream(spark, sf_dir, "events")
    rollouts = events.select(F.lit("student").alias("model"), F.col("user_id").alias("task"), F.lit("stage1").alias("stratum"), F.when(F.col("event_type") != "error", F.col("event_type").isin("purchase", "click")).alias("passed"))
    return S.drained(S.support_counts(rollouts), "complete")


def q_w05_stream_dedup(spark, sf_dir):
    """Turns of a stream once each, by run."""
    turns = S.table_stream(spark, sf_dir, "turns").where(F.col("run_id").isNotNull()).dropDuplicates(["turn_id"])
    return S.drained(turns.groupBy("run_id").agg(F.count("*").alias("n")), "complete")


def q_u01_sql_functions(spark, sf_dir):
    """Unbiased pass@k and the exact paired test as SQL functions."""
    sqlfuncs.register(spark)
    rows = view(spark, sf_dir, "v_rollouts").where("passed IS NOT NULL").groupBy("model", "task", "stratum").agg(F.count("*").cast("int").alias("n"), F.count_if("passed").cast("int").alias("c"))
    return rounded(rows.select("model", "task", "stratum", F.expr("pass_at_k(n, c, 4)").alias("pass_at_4"), F.expr("mcnemar_exact_p(c, n - c)").alias("p"), F.expr("is_majority(c, n)").alias("majority")))


def q_u02_split_diff(spark, sf_dir):
    """The table function over diffs made of part names."""
    sqlfuncs.register(spark)
    diffs = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("diff --git a/src/"), F.col("p_brand"), F.lit(" b/src/"), F.col("p_brand"), F.lit("\n+x\ndiff --git a/t b/t\n-y\n")).alias("diff"))
    return spark.sql("SELECT d.id, s.pos, s.path FROM {d} d, LATERAL split_diff(d.diff) s", d=diffs)


_PASSK4 = "CASE WHEN n < 4 THEN NULL WHEN n - c < 4 THEN 1.0 ELSE 1 - exp(lgamma(n - c + 1) + lgamma(n - 4 + 1) - lgamma(n - c - 4 + 1) - lgamma(n + 1)) END"
QUERIES = {name: f for name, f in dict(globals()).items() if name.startswith("q_")}
SQL = {
    "q_w02_minute_means": """WITH g AS (SELECT *, CASE WHEN logged_at IS NULL OR logged_at = 0 OR isnan(logged_at) THEN CASE WHEN sampled_at = 0 THEN NULL ELSE sampled_at END ELSE logged_at END AS raw FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at) AS rn FROM gpu_log) WHERE rn = 1 AND error IS NULL),
t AS (SELECT endpoint, gpu_util_pct, CAST(round(CASE WHEN raw > 1e11 THEN raw * 1e3 ELSE raw * 1e6 END) AS BIGINT) AS us FROM g WHERE raw IS NOT NULL)
SELECT endpoint, us // 60000000 * 60 AS minute, count(*) AS n, round(avg(gpu_util_pct), 6) AS util FROM t WHERE (us // 60000000 + 1) * 60000000 <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM t) GROUP BY 1, 2""",
    "q_w02_sessions": """WITH g AS (SELECT *, CASE WHEN logged_at IS NULL OR logged_at = 0 OR isnan(logged_at) THEN CASE WHEN sampled_at = 0 THEN NULL ELSE sampled_at END ELSE logged_at END AS raw FROM gpu_log),
t AS (SELECT endpoint, CAST(round(CASE WHEN raw > 1e11 THEN raw * 1e3 ELSE raw * 1e6 END) AS BIGINT) AS us FROM g WHERE raw IS NOT NULL),
l AS (SELECT endpoint, us, us - lag(us) OVER (PARTITION BY endpoint ORDER BY us) AS gap FROM t),
s AS (SELECT *, count(*) FILTER (gap IS NULL OR gap >= 1200000000) OVER (PARTITION BY endpoint ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM l),
h AS (SELECT endpoint, k, count(*) AS n, min(us) AS first_us, max(us) + 1200000000 AS ends FROM s GROUP BY 1, 2)
SELECT endpoint, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n, min(first_us) AS first_us FROM h WHERE ends <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM t) GROUP BY 1""",
    "q_w04_stream_passk": "SELECT 'student' AS model, user_id AS task, 'stage1' AS stratum, count(*) AS n, count(*) FILTER (event_type IN ('purchase', 'click')) AS c FROM events WHERE event_type <> 'error' GROUP BY 2",
    "q_w05_stream_dedup": "SELECT run_id, count(DISTINCT turn_id) AS n FROM turns WHERE run_id IS NOT NULL GROUP BY 1",
    "q_w03_stream_rate": "WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY ingested_at) AS rn FROM vllm_metrics) WHERE rn = 1), o AS (SELECT metric_id, endpoint, gen_tokens_total - lag(gen_tokens_total) OVER w AS more, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS sec FROM m WHERE error IS NULL AND gen_tokens_total IS NOT NULL WINDOW w AS (PARTITION BY endpoint ORDER BY ts, metric_id)) SELECT endpoint, metric_id, round(CASE WHEN more >= 0 AND sec > 0 THEN more / sec END, 6) AS tokens_per_sec FROM o",
    "q_u01_sql_functions": f"WITH r AS (SELECT model, task, stratum, count(*) AS n, count(*) FILTER (passed) AS c FROM {{v_rollouts}} WHERE passed IS NOT NULL GROUP BY 1, 2, 3) SELECT model, task, stratum, round({_PASSK4}, 9) AS pass_at_4, round(least(1.0, 2 * list_sum(list_transform(range(0, least(c, n - c) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))))), 9) AS p, c * 2 > n AS majority FROM r",
    "q_u02_split_diff": "SELECT p_partkey AS id, CAST(k AS INT) AS pos, CASE k WHEN 0 THEN concat('src/', p_brand) ELSE 't' END AS path FROM part CROSS JOIN (SELECT unnest([0, 1]) AS k)",
}
SQL = {name: oracle(text) for name, text in SQL.items()}
