"""Queries of readers and writers: what is written to the shared folder in a format of its own is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.operators import support as S
from spanwright.plans import support, tokens
from spanwright.plans.views import oracle, rounded, view
from spanwright.runtime import path_exists, scratch
from spanwright.sources import files, sinks

#: Entries of one recorded manifest, or traces of one recorded file.
A_FILE = 500


def _one_file_each(spark, rows, name):
    """Rows (part, value) as a folder of files with one value each; its path."""
    path = scratch(spark, name)
    rows.write.partitionBy("part").text(path)
    return path


def _listed(spark, sf_dir):
    return view(spark, sf_dir, "traces").where(F.col("run_id").isNotNull() & F.col("ordinal").isNotNull())


def q_a01_manifest(spark, sf_dir):
    """Manifests of listed runs: entries in order, their paths resolved against the manifest's folder."""
    entry = F.struct("ordinal", F.struct(F.concat(F.lit("t/"), F.col("run_id"), F.lit(".json")).alias("path"), "outcome", "model", "task").alias("e"))
    parts = _listed(spark, sf_dir).groupBy(F.floor(F.col("ordinal") / A_FILE).alias("part")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"])).alias("value"))
    found = files.manifest(spark, _one_file_each(spark, parts, "manifests"))
    at = lambda k: F.regexp_extract("path", r"part=(-?\d+)/(.*)$", k)
    return found.select(at(1).cast("bigint").alias("part"), at(2).alias("path"), "outcome", "model", "task", "ordinal")


def _trace_files(spark, sf_dir):
    """Turns as recorded traces, some hundred a file."""
    turns = view(spark, sf_dir, "v_turns").where(F.col("run_id").isNotNull() & F.col("idx").isNotNull())
    turn = F.struct(F.col("idx").alias("index"), "turn_id", "role", "thinking", "content", F.col("tool_calls").alias("toolCalls"), F.col("tool_call_id").alias("toolCallId"), F.col("subagent_depth").alias("subagentDepth"))
    runs = turns.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "turn_id", turn.alias("t")))), lambda x: x["t"]).alias("turns"))
    lines = runs.select(F.pmod(F.xxhash64("run_id"), F.lit(16)).alias("part"), F.to_json(F.struct(F.col("run_id").alias("runId"), "turns")).alias("value"))
    path = scratch(spark, "traces")
    lines.write.partitionBy("part").text(path)
    return path


def q_a04_trace_folder(spark, sf_dir):
    """A folder of traces read strictly, with the turns' defaults filled in."""
    folder = _trace_files(spark, sf_dir)
    turns = files.exploded_turns(files.traces(spark, folder, lines=True))
    return turns.groupBy("run_id").agg(
        F.count("*").alias("n"), F.max("idx").alias("last"), F.count_if(F.col("subagent_depth") > 0).alias("deep"), F.sum(F.size("tool_calls")).alias("calls"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars")
    )


def q_a12_strict_captures(spark, sf_dir):
    """Scrapes as strict capture lines: one bad line would fail the query."""
    path = scratch(spark, "captures")
    rows = view(spark, sf_dir, "vllm_metrics").dropDuplicates(["metric_id"]).where(F.col("metric_id").isNotNull())
    rows.select(F.to_json(F.struct("metric_id", "endpoint", "verdict", "running")).alias("value")).write.text(path)
    return files.json_lines(spark, path, "metric_id bigint, endpoint string, verdict string, running double", "fail")


def q_b01_trace_writer(spark, sf_dir):
    """Traces written task by task, a later call leaving what is there: infrastructure failures are no losses and stay out."""
    path = scratch(spark, "trace-log")
    rows = view(spark, sf_dir, "traces").where(F.col("run_id").isNotNull() & (F.coalesce("status", F.lit("")) != "error")).select("run_id", "ordinal", "task", "outcome")
    sinks.append_missing(rows.where("ordinal % 2 = 0"), path, ["run_id", "ordinal"])
    sinks.append_missing(rows, path, ["run_id", "ordinal"])
    return spark.read.parquet(path)


def _report(spark, df, name):
    path = scratch(spark, name)
    sinks.write_report(df, path)
    return spark.read.schema(df.schema).json(path)


def q_b05_selection_report(spark, sf_dir):
    return _report(spark, support.q_c06_training_tasks(spark, sf_dir), "selection")


def q_b07_arms_report(spark, sf_dir):
    return rounded(_report(spark, support.q_d03_arm_comparison(spark, sf_dir), "arms"))


def q_b11_bridge_save(spark, sf_dir):
    """A token map written as it is kept, bytes and all, and read back."""
    path = scratch(spark, "bridge")
    tokens.q_d14_exact_map(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def q_b12_train_report(spark, sf_dir):
    """Counts by stratum as a training report."""
    return _report(spark, S.task_counts(view(spark, sf_dir, "v_rollouts")), "train")


def q_b16_checkpoint(spark, sf_dir):
    """Candidates done so far, written after each of three batches; the last knows all of them."""
    path = scratch(spark, "candidates")
    done = view(spark, sf_dir, "v_pulls").select("number", F.substring("m", 1, 1).alias("h"))
    for least in ("a", "5", "0"):
        sinks.append_missing(done.where(F.col("h") >= least).select("number"), path, ["number"])
    return spark.read.parquet(path) if path_exists(spark, path) else done.select("number").limit(0)


_RUNS = "r AS (SELECT * FROM traces WHERE run_id IS NOT NULL AND ordinal IS NOT NULL)"
QUERIES = {name: f for name, f in dict(globals()).items() if name.startswith("q_")}
SQL = {
    "q_a01_manifest": f"WITH {_RUNS} SELECT ordinal // 500 AS part, concat('t/', run_id, '.json') AS path, outcome, model, task, CAST(row_number() OVER (PARTITION BY ordinal // 500 ORDER BY ordinal) - 1 AS INT) AS ordinal FROM r",
    "q_a04_trace_folder": "SELECT run_id, count(*) AS n, max(idx) AS last, count(*) FILTER (subagent_depth > 0) AS deep, CAST(sum(coalesce(len(tool_calls), 0)) AS BIGINT) AS calls, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS chars FROM {v_turns} WHERE run_id IS NOT NULL AND idx IS NOT NULL GROUP BY 1",
    "q_a12_strict_captures": "SELECT DISTINCT metric_id, endpoint, verdict, running FROM vllm_metrics WHERE metric_id IS NOT NULL",
    "q_b01_trace_writer": "SELECT run_id, ordinal, task, outcome FROM traces WHERE run_id IS NOT NULL AND coalesce(status, '') <> 'error'",
    "q_b12_train_report": "SELECT model, task, stratum, count(*) AS n, count(*) FILTER (passed) AS c FROM {v_rollouts} WHERE passed IS NOT NULL GROUP BY 1, 2, 3",
    "q_b16_checkpoint": "SELECT doc_id AS number FROM documents WHERE text IS NOT NULL",
}
SQL = {name: oracle(text) for name, text in SQL.items()}
SQL |= {"q_b05_selection_report": support.SQL["q_c06_training_tasks"], "q_b07_arms_report": support.SQL["q_d03_arm_comparison"], "q_b11_bridge_save": tokens.SQL["q_d14_exact_map"]}
