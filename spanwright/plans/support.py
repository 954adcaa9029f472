"""Queries of the rollout-support family: pass@k, luck, routing and arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import support as S
from spanwright.plans.views import oracle, rounded, view


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.task_counts(view(spark, sf_dir, "v_rollouts"))


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.by_stratum(_counts(spark, sf_dir))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pass_rates(view(spark, sf_dir, "v_rollouts"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.routed_cells(S.support_curves(_strata(spark, sf_dir)), view(spark, sf_dir, "v_task_caps"), "student", "teacher")


def _holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.holdout_split(view(spark, sf_dir, "v_task_caps"), 0.2, 7)


def q_e02_pass_rates(spark, sf_dir):
    return rounded(_rates(spark, sf_dir))


def q_c05_in_band(spark, sf_dir):
    return S.in_band(_rates(spark, sf_dir)).select("model", "task", "in_band", "majority")


def q_e03_passk_curves(spark, sf_dir):
    return rounded(S.task_curves(_counts(spark, sf_dir)))


def q_c07_escalation(spark, sf_dir):
    return S.escalation(_strata(spark, sf_dir))


def q_d11_luck(spark, sf_dir):
    return S.with_luck(_strata(spark, sf_dir)).where("luck").select("model", "task")


def q_d12_luck_resolution(spark, sf_dir):
    lucky = S.with_luck(_strata(spark, sf_dir)).where("luck").select("model", "task")
    last = F.regexp_extract("task", r"(\d+)$", 1).cast("int")
    resamples = lucky.withColumn("u", last).where(F.col("u") % 4 != 0).select(
        "model", "task", F.lit(32).alias("resample_n"), (F.col("u") % 3).alias("resample_c"), F.when(F.col("u") % 5 != 0, F.col("u") % 2 == 1).alias("patch_matches_gold")
    )
    return S.luck_resolution(lucky, resamples)


def q_c08_support_class(spark, sf_dir):
    return S.support_class(_strata(spark, sf_dir)).select("model", "task", "support")


def q_e21_support_hist(spark, sf_dir):
    return S.support_class(_strata(spark, sf_dir)).groupBy("model", "support").agg(F.count("*").alias("n"))


def q_d24_capability_means(spark, sf_dir):
    return rounded(S.capability_means(S.task_curves(_counts(spark, sf_dir)), _strata(spark, sf_dir), view(spark, sf_dir, "v_task_caps"), "stage1"))


def q_e04_pooling_bias(spark, sf_dir):
    return S.pooling_bias(_strata(spark, sf_dir))


def q_d07_curves(spark, sf_dir):
    return rounded(S.support_curves(_strata(spark, sf_dir)))


def q_c10_routes(spark, sf_dir):
    return _cells(spark, sf_dir)


def q_e05_route_counts(spark, sf_dir):
    return S.route_counts(_cells(spark, sf_dir))


def q_d27_b_arms(spark, sf_dir):
    return S.b_arms(_cells(spark, sf_dir), _holdout(spark, sf_dir))


def q_e22_method_mix(spark, sf_dir):
    return S.method_mix(S.b_arms(_cells(spark, sf_dir), _holdout(spark, sf_dir), only_preregistered=True))


def q_d03_arm_comparison(spark, sf_dir):
    """The student's and the teacher's first stages as two arms."""
    first = _counts(spark, sf_dir).where("stratum = 'stage1'").select("model", "task", F.col("c").alias("passed"), "n")
    return rounded(S.compare_rates(first.where("model = 'teacher'"), first.where("model = 'student'"), resolvable=0.05))


def q_g09_holdout_split(spark, sf_dir):
    return _holdout(spark, sf_dir)


def q_d26_control_pool(spark, sf_dir):
    return S.control_pool(_rates(spark, sf_dir).where("model = 'student'"), _holdout(spark, sf_dir), 1000, 3)


def q_c06_training_tasks(spark, sf_dir):
    """Distinct tasks of lost runs with a measured rate in the band."""
    lost = view(spark, sf_dir, "v_rollouts").where(~F.col("passed")).select("task").distinct()
    return S.in_band(_rates(spark, sf_dir).where("model = 'student'")).where("in_band").join(lost, "task", "left_semi").select("task")


def q_f08_group_advantage(spark, sf_dir):
    """Line items of an order as a group, their discounts as rewards."""
    rewards = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("member"), F.col("l_discount").alias("reward"))
    return rounded(S.group_advantage(rewards).select("group", "member", "advantage"), 6)


def q_d05_task_capabilities(spark, sf_dir):
    """The capabilities that the candidate's lost runs of each task lack."""
    runs = view(spark, sf_dir, "v_runs").where((F.col("outcome") == "loss") & F.col("task").isNotNull())
    lacking = view(spark, sf_dir, "v_labels").where(F.col("label") == "LACKING")
    return runs.join(lacking, "run_id").groupBy("task").agg(F.array_join(F.array_sort(F.collect_set("capability_id")), ",").alias("capabilities"))


def q_e16_mean_of_rates(spark, sf_dir):
    """Mean of the measured rates, and what a task solved by majority costs in seconds."""
    cost = view(spark, sf_dir, "v_rollouts").groupBy("model").agg(F.sum("elapsed_sec").alias("seconds"))
    mean = S.in_band(_rates(spark, sf_dir)).groupBy("model").agg(F.avg("rate").alias("mean_rate"), F.count_if("majority").alias("solved"))
    return rounded(mean.join(cost, "model").select("model", "mean_rate", "solved", F.try_divide(F.col("seconds"), F.col("solved")).alias("seconds_per_solved")), 6)


_C = """counts AS (SELECT model, task, stratum, count(*) AS n, count(*) FILTER (passed) AS c FROM {v_rollouts} WHERE passed IS NOT NULL GROUP BY 1, 2, 3)"""
_S = _C + """,
strata AS (SELECT model, task, max(n) FILTER (stratum = 'stage1') AS n1, max(c) FILTER (stratum = 'stage1') AS c1, max(n) FILTER (stratum = 'stage2') AS n2, max(c) FILTER (stratum = 'stage2') AS c2 FROM counts GROUP BY 1, 2),
lucky AS (SELECT *, coalesce(c2 > 0 AND (n1 IS NULL OR (n1 > 0 AND c1 = 0)), false) AS luck FROM strata)"""
_R = """rates AS (SELECT model, task, count(*) FILTER (passed) AS p, count(*) AS n FROM {v_rollouts} WHERE passed IS NOT NULL GROUP BY 1, 2)"""


def _passk(n: str, c: str, k: str) -> str:
    return f"CASE WHEN {n} <= 0 OR {k} > {n} THEN NULL WHEN {n} - {c} < {k} THEN 1.0 ELSE 1 - exp(lgamma({n} - {c} + 1) + lgamma({n} - {k} + 1) - lgamma({n} - {c} - {k} + 1) - lgamma({n} + 1)) END"


_CURVES = (
    _S
    + f""",
used AS (SELECT *, CASE WHEN coalesce(n2, 0) > 0 THEN n2 ELSE n1 END AS n, CASE WHEN coalesce(n2, 0) > 0 THEN c2 ELSE c1 END AS c FROM lucky),
curves AS (SELECT model, task, CASE WHEN n > 0 THEN c / n END AS pass1, CASE WHEN coalesce(n2, 0) > 0 THEN n2 ELSE 0 END AS n32, CASE WHEN coalesce(n2, 0) > 0 THEN c2 ELSE 0 END AS c32, luck FROM used)"""
)
_CELLS = (
    _CURVES
    + """,
facts AS (SELECT t.task, k.capability, coalesce(s.luck, false) AS luck, s.pass1 AS sp, 
  CASE WHEN s.n32 > 0 THEN s.c32 = 0 WHEN s.pass1 > 0 THEN false END AS out, CASE WHEN r.n32 > 0 THEN r.c32 * 32 <= r.n32 WHEN r.pass1 > 0 THEN false END AS near
  FROM (SELECT DISTINCT task FROM curves) t LEFT JOIN (SELECT * FROM curves WHERE model = 'student') s ON s.task = t.task LEFT JOIN (SELECT * FROM curves WHERE model = 'teacher') r ON r.task = t.task
  JOIN {v_task_caps} k ON k.task = t.task),
ruled AS (SELECT *, CASE WHEN luck THEN 'R0_luck_pending' WHEN sp >= 0.75 THEN 'R4_no_deficit' WHEN out IS NULL OR near IS NULL THEN 'R6_underpowered' WHEN out AND near THEN 'R3_frontier_limited'
  WHEN out THEN 'R2_outside_student_support' WHEN near THEN 'R5_teacher_no_support' WHEN sp <= 0.25 THEN 'R1_in_support_unreliable' ELSE 'R7_mid_band' END AS rule FROM facts),
cells AS (SELECT task, capability, CASE substr(rule, 1, 2) WHEN 'R1' THEN 'RL' WHEN 'R7' THEN 'RL' WHEN 'R2' THEN 'OPD' WHEN 'R4' THEN 'NONE' ELSE 'QUARANTINE' END AS route, rule,
  CASE substr(rule, 1, 2) WHEN 'R0' THEN 'luck_pending' WHEN 'R6' THEN 'underpowered' WHEN 'R3' THEN 'frontier_limited' WHEN 'R5' THEN 'frontier_limited' END AS cause, substr(rule, 1, 2) <> 'R7' AS preregistered FROM ruled)"""
)
_HOLD = """tasks AS (SELECT DISTINCT task FROM {v_task_caps}),
hold AS (SELECT task FROM (SELECT task, row_number() OVER (ORDER BY md5(concat(task, ':7'))) AS k FROM tasks) WHERE k <= (SELECT round_even(count(*) * 0.2, 0) FROM tasks))"""
_ARMS = """,
trainable AS (SELECT * FROM cells WHERE route IN ('RL', 'OPD') AND task NOT IN (SELECT task FROM hold)),
arms AS (SELECT 'B1' AS arm, task, capability, route AS assigned, preregistered FROM trainable UNION ALL SELECT 'B2', task, capability, CASE route WHEN 'RL' THEN 'OPD' ELSE 'RL' END, preregistered FROM trainable
  UNION ALL SELECT 'B3', task, capability, 'RL', preregistered FROM trainable UNION ALL SELECT 'B4', task, capability, 'OPD', preregistered FROM trainable)"""

QUERIES = {name: f for name, f in dict(globals()).items() if name.startswith("q_")}
SQL = {
    "q_e02_pass_rates": f"WITH {_R} SELECT model, task, p AS passed, n, round(p / n, 9) AS rate FROM rates",
    "q_c05_in_band": f"WITH {_R} SELECT model, task, p / n BETWEEN 0.10 AND 0.40 AS in_band, p * 2 > n AS majority FROM rates",
    "q_e03_passk_curves": f"WITH {_C} SELECT model, task, stratum, n, c, k, round({_passk('n', 'c', 'k')}, 9) AS pass_at_k FROM counts CROSS JOIN (SELECT CAST(unnest([1, 4, 8, 16, 32]) AS INT) AS k)",
    "q_c07_escalation": f"WITH {_S} SELECT model, task FROM strata WHERE n1 > 0 AND c1 = 0",
    "q_d11_luck": f"WITH {_S} SELECT model, task FROM lucky WHERE luck",
    "q_d12_luck_resolution": f"WITH {_S}, u AS (SELECT model, task, CAST(regexp_extract(task, '([0-9]+)$', 1) AS INT) AS u FROM lucky WHERE luck), r AS (SELECT model, task, CASE WHEN u % 4 = 0 THEN 'not_resampled' WHEN u % 3 = 0 THEN 'resample_failed' WHEN u % 5 = 0 THEN 'patch_not_inspected' WHEN u % 2 <> 1 THEN 'patch_differs' ELSE 'cleared' END AS reason FROM u) SELECT model, task, reason = 'cleared' AS cleared, reason FROM r",
    "q_c08_support_class": f"WITH {_S} SELECT model, task, CASE WHEN coalesce(n1, 0) + coalesce(n2, 0) = 0 THEN 'no_rollouts' WHEN coalesce(c1, 0) + coalesce(c2, 0) > 0 THEN 'in_support' WHEN coalesce(n2, 0) >= 24 THEN 'outside_support' ELSE 'undetermined' END AS support FROM strata",
    "q_e21_support_hist": f"WITH {_S} SELECT model, CASE WHEN coalesce(n1, 0) + coalesce(n2, 0) = 0 THEN 'no_rollouts' WHEN coalesce(c1, 0) + coalesce(c2, 0) > 0 THEN 'in_support' WHEN coalesce(n2, 0) >= 24 THEN 'outside_support' ELSE 'undetermined' END AS support, count(*) AS n FROM strata GROUP BY 1, 2",
    "q_d24_capability_means": f"WITH {_S} SELECT c.model, k.capability, ks.k, count(*) FILTER (NOT l.luck) AS n_tasks, count(*) FILTER (l.luck) AS luck_excluded, round(avg({_passk('c.n', 'c.c', 'ks.k')}) FILTER (NOT l.luck), 9) AS mean_pass FROM counts c JOIN {{v_task_caps}} k ON k.task = c.task JOIN lucky l ON l.model = c.model AND l.task = c.task CROSS JOIN (SELECT CAST(unnest([1, 4, 8, 16, 32]) AS INT) AS k) ks WHERE c.stratum = 'stage1' GROUP BY 1, 2, 3",
    "q_e04_pooling_bias": f"WITH {_S}, b AS (SELECT *, abs(({_passk('n1 + n2', 'c1 + c2', 'least(8, n1 + n2)')}) - CASE WHEN least(8, n1) IN (1, 4, 8) THEN {_passk('n1', 'c1', 'least(8, n1)')} END) > 1e-12 AS d FROM strata WHERE n1 IS NOT NULL AND n2 IS NOT NULL) SELECT model, count(*) AS escalated, count(*) FILTER (d) AS changed, bool_or(coalesce(d, false)) AS biased FROM b GROUP BY 1",
    "q_d07_curves": f"WITH {_CURVES} SELECT model, task, round(pass1, 9) AS pass1, n32, c32, luck FROM curves",
    "q_c10_routes": f"WITH {_CELLS} SELECT * FROM cells",
    "q_e05_route_counts": f"WITH {_CELLS}, g AS (SELECT route, rule, cause, capability, grouping(route, rule, cause, capability) AS g, count(*) AS n, count(*) FILTER (NOT preregistered) AS n_not_preregistered FROM cells GROUP BY GROUPING SETS ((route), (rule), (cause), (capability, route), ())) SELECT CASE g WHEN 7 THEN 'route' WHEN 11 THEN 'rule' WHEN 13 THEN 'cause' WHEN 6 THEN 'capability_route' ELSE 'all' END AS grain, route, rule, cause, capability, n, n_not_preregistered FROM g WHERE NOT (g = 13 AND cause IS NULL)",
    "q_d27_b_arms": f"WITH {_CELLS}, {_HOLD}{_ARMS} SELECT arm, task, capability, assigned FROM arms",
    "q_e22_method_mix": f"WITH {_CELLS}, {_HOLD}{_ARMS} SELECT arm, count(*) FILTER (assigned = 'RL') AS rl, count(*) FILTER (assigned = 'OPD') AS opd FROM arms WHERE preregistered GROUP BY 1",
    "q_d03_arm_comparison": f"""WITH {_C}, p AS (SELECT a.c AS c1, a.n AS n1, b.c AS c2, b.n AS n2 FROM counts a JOIN counts b ON a.task = b.task WHERE a.model = 'teacher' AND b.model = 'student' AND a.stratum = 'stage1' AND b.stratum = 'stage1'),
s AS (SELECT count(*) AS shared, count(*) AS paired_n, avg(c1 / n1 - c2 / n2) AS mean_delta, count(*) FILTER (c1 / n1 > c2 / n2) AS first_wins, count(*) FILTER (c1 / n1 < c2 / n2) AS second_wins, count(*) FILTER (c1 / n1 = c2 / n2) AS ties,
  count(*) FILTER (c1 * 2 > n1 AND NOT c2 * 2 > n2) AS b, count(*) FILTER (c2 * 2 > n2 AND NOT c1 * 2 > n1) AS c FROM p),
t AS (SELECT *, CASE WHEN b + c > 0 THEN least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))))) END AS p FROM s)
SELECT shared, paired_n, round(mean_delta, 9) AS mean_delta, first_wins, second_wins, ties, b AS first_only, c AS second_only, round(p, 9) AS p_value, coalesce(p < 0.05, false) AS significant, abs(mean_delta) >= 0.05 AS resolvable FROM t""",
    "q_g09_holdout_split": f"WITH {_HOLD} SELECT task FROM hold",
    "q_d26_control_pool": f"WITH {_HOLD}, {_R}, f AS (SELECT task FROM rates WHERE model = 'student' AND p / n BETWEEN 0.10 AND 0.40 AND task NOT IN (SELECT task FROM hold)) SELECT task FROM f ORDER BY md5(concat(task, ':3')) LIMIT 1000",
    "q_c06_training_tasks": f"WITH {_R} SELECT task FROM rates WHERE model = 'student' AND p / n BETWEEN 0.10 AND 0.40 AND task IN (SELECT task FROM {{v_rollouts}} WHERE NOT passed)",
    "q_f08_group_advantage": 'WITH s AS (SELECT l_orderkey AS "group", l_linenumber AS member, l_discount - avg(l_discount) OVER w AS d, stddev_pop(l_discount) OVER w AS sd FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) SELECT "group", member, round(CASE WHEN sd < 1e-8 THEN 0.0 ELSE d / sd END, 6) AS advantage FROM s',
    "q_d05_task_capabilities": "SELECT task, array_to_string(list_sort(list(DISTINCT capability_id)), ',') AS capabilities FROM {v_runs} r JOIN {v_labels} l ON l.run_id = r.run_id WHERE outcome = 'loss' AND task IS NOT NULL AND label = 'LACKING' GROUP BY 1",
    "q_e16_mean_of_rates": f"WITH {_R}, c AS (SELECT model, sum(elapsed_sec) AS s FROM {{v_rollouts}} GROUP BY 1) SELECT r.model, round(avg(p / n), 6) AS mean_rate, count(*) FILTER (p * 2 > n) AS solved, round(any_value(c.s) / nullif(count(*) FILTER (p * 2 > n), 0), 6) AS seconds_per_solved FROM rates r JOIN c ON c.model = r.model GROUP BY 1",
}
SQL = {name: oracle(text) for name, text in SQL.items()}
