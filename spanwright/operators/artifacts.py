"""What files and recorded outputs of a run amount to: discovery, provenance, verdicts, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.stats import log_sum_exp
from spanwright.operators.trajectory import EXEC_TOOLS

def discovered_trials(*scans: DataFrame) -> DataFrame:
    """Trial folders (trial) that any scan found, each once, with how many kinds of file each has."""
    every = scans[0].select("trial").distinct()
    for s in scans[1:]:
        every = every.union(s.select("trial").distinct())
    return every.groupBy("trial").agg(F.count("*").alias("kinds"))


def preferred_source(log: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """Rows of the log for every key that has any, else the report's."""
    return log.unionByName(report.join(log.select(key).distinct(), key, "left_anti"))


def bridge_bytes(maps: DataFrame) -> DataFrame:
    """Bytes of a saved bridge's JSON maps (side, value) from id to hex."""
    pairs = maps.select("side", F.explode(F.from_json("value", "map<string,string>")).alias("id", "hex"))
    return pairs.select("side", F.col("id").cast("int").alias("token_id"), F.unhex("hex").alias("bytes"))


def round_trip_faults(vocab: DataFrame, encoded: DataFrame) -> DataFrame:
    """Texts (ex_id, text, ids) whose tokens' bytes don't join to the text's."""
    parts = encoded.select("ex_id", "text", F.posexplode("ids").alias("pos", "token_id")).join(vocab, "token_id", "left")
    joined = parts.groupBy("ex_id", "text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))), lambda x: x["h"]), "").alias("h"), F.count_if(F.col("bytes").isNull()).alias("unknown"))
    return joined.where((F.col("unknown") > 0) | (F.col("h") != F.hex(F.encode("text", "UTF-8")))).select("ex_id")


def provenance(tasks: DataFrame) -> DataFrame:
    """Per task (task, declared, patched, shipped): declared tests whose file no patch has, and whether the shipped list is the declared one."""
    files = F.array_distinct(F.transform("declared", lambda d: F.split_part(d, F.lit("::"), F.lit(1))))
    return tasks.select("task", F.array_join(F.array_sort(F.array_except(files, "patched")), ",").alias("orphans"), (F.array_sort("declared") == F.array_sort("shipped")).alias("shipped_agrees"))


def command_resolved(resolved: Column, untracked: Column, exit_code: Column) -> Column:
    """Resolved, and the command itself ran cleanly."""
    return resolved & (untracked == 0) & (exit_code == 0)


def consistent_replay(results: DataFrame) -> DataFrame:
    """Per run over replayed steps (run_id, step, checkable, same): verified if anything could be checked, consistent if all that was agreed."""
    return results.groupBy("run_id").agg(F.bool_or("checkable").alias("verified"), F.bool_and(F.col("same") | ~F.col("checkable")).alias("consistent"), F.min(F.when(F.col("checkable") & ~F.col("same"), F.col("step"))).alias("first_fault"))


def shell_text(name: Column, args: Column) -> Column:
    """The command that a call runs; null for other tools."""
    v = F.try_parse_json(args)
    first = F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in ("cmd", "command", "input")))
    return F.when(F.lower(name).isin(*EXEC_TOOLS), first)


def first_json_object(text: Column) -> Column:
    """The first object without inner braces in a text; null for none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{[^{}]*\})", 1), F.lit(""))


def token_logprob(logits: Column, at: Column) -> Column:
    """Log probability of one token under an array of logits."""
    return F.element_at(logits, (at + 1).cast("int")) - log_sum_exp(logits)


def step_loss(spans: DataFrame) -> DataFrame:
    """One row: loss over spans (kind, contribution, s_sum, t_sum, n_student) by one denominator, all supervised student tokens."""
    value = F.when(F.col("kind") == "A", F.col("contribution")).when(F.col("kind") == "B", (F.col("s_sum") - F.col("t_sum")) * F.col("s_sum")).otherwise(0.0)
    counted = F.col("kind").isin("A", "B")
    return spans.agg(F.try_divide(F.sum(value), F.sum(F.when(counted, F.col("n_student")).otherwise(0))).alias("loss"), F.count_if(F.col("kind") == "A").alias("a"), F.count_if(F.col("kind") == "B").alias("b"), F.count_if(~counted).alias("dropped"))


def training_example(bisections: DataFrame) -> DataFrame:
    """The deepest prefix that still passes as an example; none where the run was dropped, unverified or never passed."""
    fits = ~F.col("dropped") & F.col("verified") & (F.col("largest") >= 0)
    return bisections.select("run_id", F.when(F.coalesce(fits, F.lit(False)), F.col("largest") + 1).alias("prefix_steps"))


def datum(prefix: Column, logprobs: Column) -> tuple[Column, Column]:
    """Teacher log probabilities padded over the prefix, and the weights that leave the prefix out."""
    return F.concat(F.array_repeat(F.lit(0.0), F.size(prefix)), logprobs), F.concat(F.array_repeat(F.lit(0), F.size(prefix)), F.array_repeat(F.lit(1), F.size(logprobs)))
