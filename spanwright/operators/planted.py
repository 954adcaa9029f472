"""Planted corpora: which deficits a perfect labeller could recover from a corpus of given size and mixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.functions.stats import rate

#: What a perfect labeller says of each kind of run about each capability.
ORACLE = (
    ("win_recovering", "PRESENT", "PRESENT", "NA", "NA"),
    ("win_clean", "NA", "PRESENT", "NA", "NA"),
    ("loss_planted", "LACKING", "PRESENT", "NA", "NA"),
    ("loss_stops_to_ask", "NA", "LACKING", "NA", "NA"),
    ("loss_wrong_output_shape", "NA", "PRESENT", "LACKING", "NA"),
    ("loss_drops_second_requirement", "NA", "PRESENT", "NA", "LACKING"),
)
CAPABILITIES = ("error_adaptation", "proceeds_without_confirmation", "follows_output_format", "completes_all_requirements")
DISTRACTORS = ("stops_to_ask", "wrong_output_shape", "drops_second_requirement")


def planted_kinds(configs: DataFrame, clean_share: float = 0.3) -> DataFrame:
    """Runs of each corpus (config, n_wins, n_losses, prevalence): (config, run, kind, outcome)."""
    clean = F.when(F.col("n_wins") > 1, F.least(F.col("n_wins") - 1, F.bround(F.col("n_wins") * clean_share).cast("int"))).otherwise(0)
    planted = F.bround(F.col("prevalence") * F.col("n_losses")).cast("int")
    sized = configs.withColumns({"n_clean": clean, "n_planted": planted})
    wins = sized.select("config", F.explode(F.sequence(F.lit(0), F.col("n_wins") - 1)).alias("i"), "n_clean").select("config", F.col("i").alias("run"), F.when(F.col("i") < F.col("n_clean"), "win_clean").otherwise("win_recovering").alias("kind"))
    other = F.element_at(F.array(*(F.lit(f"loss_{d}") for d in DISTRACTORS)), (F.pmod(F.col("i") - F.col("n_planted"), F.lit(len(DISTRACTORS))) + 1).cast("int"))
    losses = sized.select("config", "n_wins", F.explode(F.sequence(F.lit(0), F.col("n_losses") - 1)).alias("i"), "n_planted").select(
        "config", (F.col("n_wins") + F.col("i")).alias("run"), F.when(F.col("i") < F.col("n_planted"), "loss_planted").otherwise(other).alias("kind")
    )
    return wins.unionByName(losses).withColumn("outcome", F.split_part("kind", F.lit("_"), F.lit(1)))


def oracle_labels(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """The perfect labels of runs: (config, run, outcome, capability_id, ordinal, label)."""
    table = spark.createDataFrame([(kind, cap, i, labels[i]) for kind, *labels in ORACLE for i, cap in enumerate(CAPABILITIES)], "kind string, capability_id string, ordinal int, label string")
    return runs.join(F.broadcast(table), "kind").drop("kind")  # 24 rows


def ceilings(labels: DataFrame, min_gap: float = 0.20, min_support: int = 3) -> DataFrame:
    """Per corpus: the capability that would be selected, whether it is the planted one, and why not."""
    lacking, relevant = F.col("label") == "LACKING", F.col("label") != "NA"
    win = F.col("outcome") == "win"
    s = labels.groupBy("config", "capability_id", "ordinal").agg(
        F.count_if(relevant & win).alias("rw"), F.count_if(relevant & ~win).alias("rl"), F.count_if(lacking & win).alias("lw"), F.count_if(lacking & ~win).alias("ll"), F.count_if(~win).alias("losses")
    )
    gap = rate(F.col("ll"), F.col("rl")) - rate(F.col("lw"), F.col("rw"))
    scored = s.select("config", "capability_id", "ordinal", "rw", "rl", gap.alias("gap"), (F.coalesce(gap, F.lit(0.0)) * F.coalesce(rate(F.col("ll"), F.col("losses")), F.lit(0.0))).alias("priority"))
    order = Window.partitionBy("config").orderBy(F.desc("priority"), "ordinal")
    ranked = scored.withColumns({"rank": F.row_number().over(order) - 1, "fits": F.coalesce((F.col("gap") >= min_gap) & (F.least("rw", "rl") >= min_support), F.lit(False))})
    chosen = ranked.groupBy("config").agg(
        F.min_by("capability_id", F.when(F.col("fits"), F.col("rank"))).alias("first"), F.bool_or("fits").alias("any"), F.max(F.when(F.col("ordinal") == 0, F.col("rank"))).alias("planted_rank")
    )
    selected = F.when(F.col("any"), F.col("first"))
    recovered = F.coalesce(selected == CAPABILITIES[0], F.lit(False))
    verdict: Column = F.when(recovered, "recovered").when(F.col("planted_rank") == 0, "top_ranked_but_below_threshold").otherwise("outranked_by_distractor")
    return chosen.select("config", selected.alias("selected"), recovered.alias("recovered"), verdict.alias("verdict"))
