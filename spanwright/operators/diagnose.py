"""Contrasting the runs of two models: paired gaps, capability deficits, exact paired tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions.stats import MIN_DISCORDANT, mcnemar_exact_p, rate


def listed_runs(traces: DataFrame) -> DataFrame:
    """One row per run: the entry of the largest ordinal holds; a missing outcome follows from the status."""
    last = traces.groupBy("run_id").agg(F.max_by(F.struct("task", "model", "outcome", "status", "ordinal"), "ordinal").alias("e")).select("run_id", "e.*")
    won = F.coalesce(F.col("outcome"), F.when(F.col("status") == "success", "win").otherwise("loss"))
    return last.select("run_id", "task", "model", won.alias("outcome"), "ordinal")


def last_per_task(runs: DataFrame) -> DataFrame:
    """The last listed run of each (model, task); runs without a task drop out."""
    return runs.where(F.col("task").isNotNull() & F.col("model").isNotNull()).groupBy("model", "task").agg(F.max_by(F.struct("run_id", "outcome"), "ordinal").alias("e")).select("model", "task", "e.*")


def _pairs(runs: DataFrame, frontier: str, candidate: str) -> DataFrame:
    """One row per task with the outcomes of both arms side by side: one exchange and no join."""
    own = last_per_task(runs.where(F.col("model").isin(frontier, candidate)))
    side = lambda model: F.max(F.when(F.col("model") == model, F.struct("run_id", "outcome")))
    both = own.groupBy("task").agg(side(frontier).alias("f"), side(candidate).alias("c"))
    return both.where(F.col("f").isNotNull() & F.col("c").isNotNull())


def paired_gap(runs: DataFrame, frontier: str, candidate: str) -> DataFrame:
    """One row: win rates of both models over the tasks that both attempted, and their gap.

    ``*_attempted`` counts all runs with a task before pairing and without removing repeats.
    """
    won = _pairs(runs, frontier, candidate).agg(
        F.count("*").alias("paired_n"), F.count_if(F.col("f.outcome") == "win").alias("frontier_wins"), F.count_if(F.col("c.outcome") == "win").alias("candidate_wins")
    )
    tried = runs.where(F.col("task").isNotNull()).agg(F.count_if(F.col("model") == frontier).alias("frontier_attempted"), F.count_if(F.col("model") == candidate).alias("candidate_attempted"))
    n = F.col("paired_n")
    return won.crossJoin(tried).select(  # one row by one row
        "*",
        rate(F.col("frontier_wins"), n).alias("frontier_rate"),
        rate(F.col("candidate_wins"), n).alias("candidate_rate"),
        rate(F.col("frontier_wins") - F.col("candidate_wins"), n).alias("gap"),
    )


def cross_model_contrast(runs: DataFrame, frontier: str, candidate: str) -> DataFrame:
    """Wins of the frontier and losses of the candidate."""
    return runs.where(((F.col("model") == frontier) & (F.col("outcome") == "win")) | ((F.col("model") == candidate) & (F.col("outcome") == "loss")))


def deficit_scores(capabilities: DataFrame, runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per capability: LACKING rates among relevant wins and losses, gap, prevalence, priority.

    A run without a label for a capability counts as NA. Labels are aggregated by capability before
    anything is paired, so no matrix of runs and capabilities is formed.
    """
    total = runs.agg(F.count_if(F.col("outcome") == "loss").alias("losses"))
    lacking, relevant = F.col("label") == "LACKING", F.col("label") != "NA"
    win, loss = F.col("outcome") == "win", F.col("outcome") == "loss"
    counted = (
        labels.join(runs.select("run_id", "outcome"), "run_id")
        .groupBy("capability_id")
        .agg(
            F.count_if(relevant & win).alias("n_relevant_wins"),
            F.count_if(relevant & loss).alias("n_relevant_losses"),
            F.count_if(lacking & win).alias("lacking_wins"),
            F.count_if(lacking & loss).alias("lacking_losses"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    every = capabilities.join(counted, "capability_id", "left").crossJoin(total)
    scored = every.select("capability_id", "ordinal", *(zero(c) for c in ("n_relevant_wins", "n_relevant_losses", "lacking_wins", "lacking_losses")), "losses")
    base, incident = rate(F.col("lacking_wins"), F.col("n_relevant_wins")), rate(F.col("lacking_losses"), F.col("n_relevant_losses"))
    prevalence = F.coalesce(rate(F.col("lacking_losses"), F.col("losses")), F.lit(0.0))
    return scored.select(
        "capability_id", "ordinal", "n_relevant_wins", "n_relevant_losses", base.alias("baseline_rate"), incident.alias("incident_rate"), (incident - base).alias("gap"), prevalence.alias("prevalence"),
        (F.coalesce(incident - base, F.lit(0.0)) * prevalence).alias("priority"),
    )


def selected_deficit(scores: DataFrame, min_gap: float = 0.2, min_support: int = 3) -> DataFrame:
    """The capability first in rank order whose gap and support suffice; no row if none does."""
    fits = (F.col("gap") >= min_gap) & (F.least("n_relevant_wins", "n_relevant_losses") >= min_support)
    return scores.where(fits).orderBy(F.desc("priority"), "ordinal").limit(1)


def label_pairs(runs: DataFrame, labels: DataFrame, frontier: str, candidate: str) -> DataFrame:
    """Per capability: the paired test over tasks where both runs have a label other than NA."""
    pairs = _pairs(runs, frontier, candidate).select("task", F.col("f.run_id").alias("f_run"), F.col("c.run_id").alias("c_run"))
    sides = pairs.select("task", F.explode(F.array(F.struct(F.lit("f").alias("side"), F.col("f_run").alias("run_id")), F.struct(F.lit("c").alias("side"), F.col("c_run").alias("run_id")))).alias("s")).select("task", "s.*")
    judged = labels.where(F.col("label") != "NA").join(sides, "run_id")
    present = lambda side: F.max(F.when(F.col("side") == side, (F.col("label") == "PRESENT").cast("int")))
    paired = judged.groupBy("capability_id", "task").agg(present("f").alias("f"), present("c").alias("c")).where(F.col("f").isNotNull() & F.col("c").isNotNull())
    counts = paired.groupBy("capability_id").agg(
        F.count_if((F.col("f") == 1) & (F.col("c") == 0)).alias("b"), F.count_if((F.col("f") == 0) & (F.col("c") == 1)).alias("c"), F.count_if(F.col("f") == F.col("c")).alias("concordant")
    )
    discordant = F.col("b") + F.col("c")
    return counts.select("capability_id", "b", "c", "concordant", discordant.alias("discordant_n"), mcnemar_exact_p(F.col("b"), F.col("c")).alias("p_value"), (discordant < MIN_DISCORDANT).alias("underpowered"))


def replay_diagnosis(capabilities: DataFrame, runs: DataFrame, labels: DataFrame, frontier: str, candidate: str, min_support: int = 3) -> DataFrame:
    """Scores over the cross-model contrast joined with the paired tests, and whether training could help."""
    contrast = cross_model_contrast(runs, frontier, candidate)
    scores = deficit_scores(capabilities, contrast, labels)
    tests = label_pairs(runs, labels, frontier, candidate)
    trainable = F.coalesce((F.col("baseline_rate") < 1.0) & (F.col("n_relevant_wins") >= min_support), F.lit(False))
    return scores.join(tests, "capability_id", "left").withColumn("trainable", trainable)


def label_confusion(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts by true and given label; a truth without a label counts as NA."""
    joined = truth.join(labels, ["run_id", "capability_id"], "left")
    return joined.groupBy("truth", F.coalesce("label", F.lit("NA")).alias("given")).agg(F.count("*").alias("n"))
