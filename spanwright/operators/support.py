"""Rollout support: pass@k by stratum, escalation, luck, support classes, routing, and training arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.stats import majority, mcnemar_exact_p, pass_at_k, rate

K_VALUES = (1, 4, 8, 16, 32)
PASS1_LOW, PASS1_HIGH = 0.25, 0.75
BAND = (0.10, 0.40)
ROUTES = ("RL", "OPD", "QUARANTINE", "NONE")


def judged(rollouts: DataFrame) -> DataFrame:
    """Rollouts with a verdict: a failure of the infrastructure is no loss and stays out of every denominator."""
    return rollouts.where(F.col("passed").isNotNull())


def task_counts(rollouts: DataFrame) -> DataFrame:
    """n and c by (model, task, stratum); strata are never pooled."""
    return judged(rollouts).groupBy("model", "task", "stratum").agg(F.count("*").alias("n"), F.count_if("passed").alias("c"))


def task_curves(counts: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """pass@k of each count, one row per k."""
    return counts.select("*", F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")).withColumn("pass_at_k", pass_at_k(F.col("n"), F.col("c"), F.col("k")))


def pass_rates(rollouts: DataFrame) -> DataFrame:
    """Passes, rollouts and rate by (model, task)."""
    counted = judged(rollouts).groupBy("model", "task").agg(F.count_if("passed").alias("passed"), F.count("*").alias("n"))
    return counted.withColumn("rate", rate(F.col("passed"), F.col("n")))


def in_band(rates: DataFrame, low: float = BAND[0], high: float = BAND[1]) -> DataFrame:
    """Tasks whose rate lies in the band, bounds included, with the strict majority verdict."""
    return rates.select("*", F.coalesce(F.col("rate").between(low, high), F.lit(False)).alias("in_band"), majority(F.col("passed"), F.col("n")).alias("majority"))


def by_stratum(counts: DataFrame) -> DataFrame:
    """One row per (model, task) with the counts of both strata (null where not run) in one exchange."""
    of = lambda stratum, c: F.max(F.when(F.col("stratum") == stratum, F.col(c)))
    return counts.groupBy("model", "task").agg(of("stage1", "n").alias("n1"), of("stage1", "c").alias("c1"), of("stage2", "n").alias("n2"), of("stage2", "c").alias("c2"))


def escalation(strata: DataFrame) -> DataFrame:
    """Tasks whose first stage ran without a single pass."""
    return strata.where((F.col("n1") > 0) & (F.col("c1") == 0)).select("model", "task")


def with_luck(strata: DataFrame) -> DataFrame:
    """``luck``: passes turned up only in the second stage."""
    return strata.withColumn("luck", F.coalesce((F.col("c2") > 0) & (F.col("n1").isNull() | ((F.col("n1") > 0) & (F.col("c1") == 0))), F.lit(False)))


def luck_resolution(quarantined: DataFrame, resamples: DataFrame) -> DataFrame:
    """Whether each quarantined task is cleared, or why it is held.

    ``resamples`` has (model, task, resample_n, resample_c, patch_matches_gold).
    """
    joined = quarantined.join(resamples, ["model", "task"], "left")
    held = (
        F.when(F.coalesce("resample_n", F.lit(0)) <= 0, "not_resampled")
        .when(F.coalesce("resample_c", F.lit(0)) <= 0, "resample_failed")
        .when(F.col("patch_matches_gold").isNull(), "patch_not_inspected")
        .when(~F.col("patch_matches_gold"), "patch_differs")
    )
    return joined.select("model", "task", held.isNull().alias("cleared"), F.coalesce(held, F.lit("cleared")).alias("reason"))


def support_class(strata: DataFrame, stage2_n: int = 32) -> DataFrame:
    """in_support, outside_support (only after enough of the second stage), undetermined or no_rollouts."""
    n1, c1, n2, c2 = (F.coalesce(F.col(c), F.lit(0)) for c in ("n1", "c1", "n2", "c2"))
    kind = F.when(n1 + n2 == 0, "no_rollouts").when(c1 + c2 > 0, "in_support").when(n2 >= max(1, 3 * stage2_n // 4), "outside_support").otherwise("undetermined")
    return strata.withColumn("support", kind)


def capability_means(curves: DataFrame, strata: DataFrame, capabilities: DataFrame, stratum: str) -> DataFrame:
    """Mean pass@k by (model, capability) in one stratum; tasks held for luck count as excluded, not in the mean."""
    lucky = with_luck(strata).select("model", "task", "luck")
    rows = curves.where(F.col("stratum") == stratum).join(capabilities, "task").join(lucky, ["model", "task"])
    return rows.groupBy("model", "capability", "k").agg(
        F.count_if(~F.col("luck")).alias("n_tasks"), F.count_if("luck").alias("luck_excluded"), F.avg(F.when(~F.col("luck"), F.col("pass_at_k"))).alias("mean_pass")
    )


def pooling_bias(strata: DataFrame) -> DataFrame:
    """Per model: does pooling both strata change pass@8 of any task that has both?"""
    both = strata.where(F.col("n1").isNotNull() & F.col("n2").isNotNull())
    n, c = F.col("n1") + F.col("n2"), F.col("c1") + F.col("c2")
    pooled = pass_at_k(n, c, F.least(F.lit(8), n))
    alone = F.when(F.least(F.lit(8), F.col("n1")).isin(*K_VALUES), pass_at_k(F.col("n1"), F.col("c1"), F.least(F.lit(8), F.col("n1"))))
    differs = F.abs(pooled - alone) > 1e-12
    return both.groupBy("model").agg(F.count("*").alias("escalated"), F.count_if(differs).alias("changed"), F.bool_or(F.coalesce(differs, F.lit(False))).alias("biased"))


def support_curves(strata: DataFrame) -> DataFrame:
    """The curve that routing reads: the second stage where it ran, else the first."""
    second = F.coalesce(F.col("n2"), F.lit(0)) > 0
    n, c = F.when(second, F.col("n2")).otherwise(F.col("n1")), F.when(second, F.col("c2")).otherwise(F.col("c1"))
    return with_luck(strata).select(
        "model", "task", pass_at_k(n, c, 1).alias("pass1"), F.when(second, F.col("n2")).otherwise(0).alias("n32"), F.when(second, F.col("c2")).otherwise(0).alias("c32"), "luck"
    )


def _outside(pass1: Column, n32: Column, c32: Column) -> Column:
    """Proven outside support, proven inside, or null where never measured."""
    return F.when(n32 > 0, c32 == 0).when(pass1 > 0, F.lit(False))


def _near_zero(pass1: Column, n32: Column, c32: Column) -> Column:
    """At most one pass in 32, as a rate in whole numbers; null where never measured."""
    return F.when(n32 > 0, c32 * 32 <= n32).when(pass1 > 0, F.lit(False))


def routed_cells(curves: DataFrame, capabilities: DataFrame, student: str, teacher: str, low: float = PASS1_LOW, high: float = PASS1_HIGH) -> DataFrame:
    """One route for each (task, capability) that either model attempted, by the first rule that holds."""
    facts = F.struct("pass1", "n32", "c32", "luck")
    of = lambda model: F.max(F.when(F.col("model") == model, facts))
    both = curves.where(F.col("model").isin(student, teacher)).groupBy("task").agg(of(student).alias("s"), of(teacher).alias("t"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cells = both.join(capabilities, "task")
    outside, near = _outside(F.col("s.pass1"), zero("s.n32"), zero("s.c32")), _near_zero(F.col("t.pass1"), zero("t.n32"), zero("t.c32"))
    rule = (
        F.when(F.coalesce("s.luck", F.lit(False)), "R0_luck_pending")
        .when(F.col("s.pass1") >= high, "R4_no_deficit")
        .when(outside.isNull() | near.isNull(), "R6_underpowered")
        .when(outside & near, "R3_frontier_limited")
        .when(outside, "R2_outside_student_support")
        .when(near, "R5_teacher_no_support")
        .when(F.col("s.pass1") <= low, "R1_in_support_unreliable")
        .otherwise("R7_mid_band")
    )
    ruled = cells.withColumn("rule", rule)
    route = F.when(F.col("rule").startswith("R1") | F.col("rule").startswith("R7"), "RL").when(F.col("rule").startswith("R2"), "OPD").when(F.col("rule").startswith("R4"), "NONE").otherwise("QUARANTINE")
    cause = F.when(F.col("rule").startswith("R0"), "luck_pending").when(F.col("rule").startswith("R6"), "underpowered").when(F.col("rule").startswith("R3") | F.col("rule").startswith("R5"), "frontier_limited")
    return ruled.select("task", "capability", route.alias("route"), "rule", cause.alias("cause"), (~F.col("rule").startswith("R7")).alias("preregistered"))


def route_counts(cells: DataFrame) -> DataFrame:
    """Counts at every grain that is reported, from one pass with grouping sets."""
    view = cells.select("route", "rule", "cause", "capability", "preregistered")
    grouped = view.groupingSets([["route"], ["rule"], ["cause"], ["capability", "route"], []], "route", "rule", "cause", "capability").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if(~F.col("preregistered")).alias("n_not_preregistered")
    )
    grain = F.when(F.col("g") == 7, "route").when(F.col("g") == 11, "rule").when(F.col("g") == 13, "cause").when(F.col("g") == 6, "capability_route").otherwise("all")
    return grouped.select(grain.alias("grain"), "route", "rule", "cause", "capability", "n", "n_not_preregistered").where(~((F.col("grain") == "cause") & F.col("cause").isNull()))


def b_arms(cells: DataFrame, holdout: DataFrame | None = None, only_preregistered: bool = False) -> DataFrame:
    """Assignments of the four arms: routed, inverted, all RL, all OPD; the holdout trains in none."""
    trainable = cells.where(F.col("route").isin("RL", "OPD"))
    if only_preregistered:
        trainable = trainable.where("preregistered")
    if holdout is not None:
        trainable = trainable.join(holdout.select("task").distinct(), "task", "left_anti")
    once = trainable.groupBy("task", "capability").agg(F.min("route").alias("route"))
    inverted = F.when(F.col("route") == "RL", "OPD").otherwise("RL")
    arms = F.array(*(F.struct(F.lit(a).alias("arm"), r.alias("assigned")) for a, r in (("B1", F.col("route")), ("B2", inverted), ("B3", F.lit("RL")), ("B4", F.lit("OPD")))))
    return once.select("task", "capability", F.explode(arms).alias("x")).select("x.arm", "task", "capability", "x.assigned")


def method_mix(arms: DataFrame) -> DataFrame:
    """How many cells of each arm get each method."""
    return arms.groupBy("arm").agg(F.count_if(F.col("assigned") == "RL").alias("rl"), F.count_if(F.col("assigned") == "OPD").alias("opd"))


def compare_rates(first: DataFrame, second: DataFrame, resolvable: float | None = None, alpha: float = 0.05) -> DataFrame:
    """One row: paired comparison of two arms' (task, passed, n) over shared tasks."""
    a = first.select("task", F.col("passed").alias("p1"), F.col("n").alias("n1"))
    b = second.select("task", F.col("passed").alias("p2"), F.col("n").alias("n2"))
    pairs = a.join(b, "task").withColumns({"r1": rate(F.col("p1"), F.col("n1")), "r2": rate(F.col("p2"), F.col("n2"))})
    m1, m2 = majority(F.col("p1"), F.col("n1")), majority(F.col("p2"), F.col("n2"))
    counted = pairs.agg(
        F.count("*").alias("shared"),
        F.count(F.col("r1") - F.col("r2")).alias("paired_n"),
        F.avg(F.col("r1") - F.col("r2")).alias("mean_delta"),
        F.count_if(F.col("r1") > F.col("r2")).alias("first_wins"),
        F.count_if(F.col("r1") < F.col("r2")).alias("second_wins"),
        F.count_if(F.col("r1") == F.col("r2")).alias("ties"),
        F.count_if(m1 & ~m2).alias("first_only"),
        F.count_if(m2 & ~m1).alias("second_only"),
    )
    tested = counted.withColumn("p_value", mcnemar_exact_p(F.col("first_only"), F.col("second_only")))
    able = F.lit(None).cast("boolean") if resolvable is None else F.abs("mean_delta") >= resolvable
    return tested.select("*", F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("significant"), able.alias("resolvable"))


def holdout_split(tasks: DataFrame, share: float, seed: int) -> DataFrame:
    """A seeded share of the tasks, in the order of a hash of task and seed; sizes round half to even."""
    distinct = tasks.select("task").distinct()
    size = distinct.agg(F.bround(F.count("*") * F.lit(share)).cast("int").alias("size")).first().size
    return distinct.orderBy(F.md5(F.concat_ws(":", "task", F.lit(seed)))).limit(size)


def control_pool(rates: DataFrame, used: DataFrame, size: int, seed: int) -> DataFrame:
    """Tasks in the band that no other split uses, ``size`` of them in seeded order."""
    free = in_band(rates).where("in_band").join(used.select("task").distinct(), "task", "left_anti").select("task").distinct()
    return free.orderBy(F.md5(F.concat_ws(":", "task", F.lit(seed)))).limit(size)


def group_advantage(rewards: DataFrame) -> DataFrame:
    """Reward relative to its group in population standard deviations; 0 where a group doesn't vary."""
    w = Window.partitionBy("group")
    sd = F.stddev_pop("reward").over(w)
    return rewards.withColumn("advantage", F.when(sd < 1e-8, 0.0).otherwise((F.col("reward") - F.avg("reward").over(w)) / sd))
