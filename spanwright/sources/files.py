"""Readers: manifests, traces, trajectories, logs of lines, recorded responses, vocabularies.

All declare their schema, so no file is read twice, and keep the three ways to treat a bad row apart:
fail, drop, or keep it marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright import schemas


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest in order, paths resolved against its folder: (path, outcome, model, task, ordinal)."""
    text = spark.read.text(path, wholetext=True)
    folder = F.regexp_replace("_metadata.file_path", r"/[^/]*$", "")
    rows = text.select(folder.alias("folder"), F.posexplode(F.from_json("value", schemas.MANIFEST, {"mode": "FAILFAST"})).alias("ordinal", "e")).select("folder", "ordinal", "e.*")
    return rows.select(F.when(F.col("path").rlike(r"^(?:/|\w+:)"), F.col("path")).otherwise(F.concat_ws("/", "folder", "path")).alias("path"), "outcome", "model", "task", "ordinal")


def traces(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """One row per trace: (path, run_id, status, turns); the run's name defaults to the file's.

    A file holds one trace, or an array of them, or with ``lines`` one a line, so that files can be split.
    """
    rows = spark.read.schema(schemas.TRACE).option("multiLine", not lines).option("mode", "FAILFAST").json(paths)
    stem = F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.coalesce("runId", stem).alias("run_id"), F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("turns", F.array().cast(rows.schema["turns"].dataType)).alias("turns"))


def manifest_traces(spark: SparkSession, path: str) -> DataFrame:
    """The traces that a manifest lists, with its outcome where given, else the status's."""
    entries = manifest(spark, path)
    folder = path.rsplit("/", 1)[0]
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    files = spark.read.schema(schemas.TRACE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    stem = F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "")
    rows = files.select(plain("_metadata.file_path").alias("key"), F.coalesce("runId", stem).alias("run_id"), F.coalesce("status", F.lit("unknown")).alias("status"), "turns")
    won = F.coalesce("outcome", F.when(F.col("status") == "success", "win").otherwise("loss"))
    return entries.withColumn("key", plain("path")).join(rows, "key").select("run_id", "status", won.alias("outcome"), "model", "task", "ordinal", "turns")


def exploded_turns(rows: DataFrame) -> DataFrame:
    """Turns of traces (run_id, turns), with every default filled in."""
    flat = rows.select("run_id", F.explode("turns").alias("t")).select("run_id", "t.*")
    return flat.select("run_id", F.col("index").alias("idx"), "role", "thinking", "content", F.coalesce("toolCalls", F.array().cast("array<struct<id:string,name:string,args:string>>")).alias("tool_calls"), F.col("toolCallId").alias("tool_call_id"), F.coalesce("subagentDepth", F.lit(0)).alias("subagent_depth"))


def json_lines(spark: SparkSession, path: str | list[str], schema: str, bad: str = "drop") -> DataFrame:
    """Rows of JSON lines. ``bad``: ``fail``, ``drop``, or ``keep`` them in the column ``_bad`` with the others null."""
    reader = spark.read.option("mode", {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad])
    if bad == "keep":
        return reader.option("columnNameOfCorruptRecord", "_bad").schema(f"{schema}, _bad string").json(path)
    return reader.schema(schema).json(path)


def flat_message(message: Column) -> Column:
    """Text of a message that is a string or an array of typed parts; an image leaves a mark."""
    parts = F.from_json(message, "array<struct<type: string, text: string>>")
    text = F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).when(p["type"].contains("image"), F.lit("[image]")))
    return F.when(message.rlike(r"^\s*\["), F.coalesce(F.array_join(F.filter(text, lambda t: t.isNotNull()), "\n"), message)).otherwise(message)


def atif_turns(steps: DataFrame) -> DataFrame:
    """Turns of trajectory steps (run_id, steps): a step's own turn, then one tool turn per result of its observation."""
    each = steps.select("run_id", F.posexplode("steps").alias("step", "s")).select("run_id", "step", "s.*")
    role = F.when(F.col("source") == "agent", "assistant").otherwise(F.col("source"))
    calls = F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<tool_call_id:string,function_name:string,arguments:string>>")), lambda c: F.struct(c["tool_call_id"].alias("id"), c["function_name"].alias("name"), c["arguments"].alias("args")))
    own = each.where(F.col("message").isNotNull() | F.col("reasoning_content").isNotNull() | (F.size("tool_calls") > 0)).select(
        "run_id", "step", F.lit(-1).alias("result"), role.alias("role"), F.col("reasoning_content").alias("thinking"), flat_message(F.col("message")).alias("content"), calls.alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id")
    )
    results = each.select("run_id", "step", F.posexplode("observation.results").alias("result", "r")).select(
        "run_id", "step", "result", F.lit("tool").alias("role"), F.lit(None).cast("string").alias("thinking"), flat_message(F.col("r.content")).alias("content"), F.array().cast("array<struct<id:string,name:string,args:string>>").alias("tool_calls"), F.col("r.source_call_id").alias("tool_call_id")
    )
    order = Window.partitionBy("run_id").orderBy("step", "result")
    return own.unionByName(results).withColumn("idx", F.row_number().over(order) - 1).drop("step", "result")


def reachable_files(roots: DataFrame, edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """Files reached from each root (root) over references (src, dst): (root, file, depth, path), a cycle followed no further.

    One join a level: a path meets each of its references and a null one, which keeps the path itself. A kept
    path still joins by its last file, so that kept paths stay spread.
    """
    links = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col("src").alias("at"), "dst")
    links = links.unionByName(links.select("at", F.lit(None).cast(links.schema["dst"].dataType).alias("dst")).distinct()).withColumn("kept", F.lit(False))
    paths = roots.select("root", F.array("root").alias("path"), F.col("root").alias("at"), F.lit(False).alias("kept"))
    for _ in range(max_depth):
        met = paths.join(links, ["at", "kept"], "left").where(F.col("dst").isNull() | ~F.array_contains("path", F.col("dst")))
        last = F.coalesce("dst", "at")
        paths = met.select("root", F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array("dst"))).alias("path"), last.alias("at"), F.col("dst").isNull().alias("kept"))
    return paths.select("root", F.col("at").alias("file"), (F.size("path") - 1).alias("depth"), "path")


#: The files of an emitted task by what they hold.
TASK_FILES = {"task.toml": "task_toml", "environment/Dockerfile": "dockerfile", "tests/test.sh": "test_sh", "solution/patch.diff": "oracle", "tests/f2p.json": "f2p_json"}


def task_folders(spark: SparkSession, path: str) -> DataFrame:
    """Emitted tasks under a folder, one row each: (task, task_toml, dockerfile, test_sh, oracle, f2p_json), null where a file is missing."""
    found = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    inside = "|".join(k.replace(".", r"\.") for k in TASK_FILES)
    named = found.select(F.regexp_extract("path", rf"/([^/]+)/(?:{inside})$", 1).alias("task"), F.regexp_extract("path", rf"/({inside})$", 1).alias("name"), "value").where(F.col("task") != "")
    return named.groupBy("task").agg(*(F.max(F.when(F.col("name") == k, F.col("value"))).alias(v) for k, v in TASK_FILES.items()))


def newest(rows: DataFrame, key: str, preferred: Column) -> DataFrame:
    """One row per key: the preferred kind (least ``preferred``) and of that the newest (``modified``)."""
    order = Window.partitionBy(key).orderBy(preferred, F.desc("modified"), "path")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a recorded log: records end with 0x1e, the seven fields are parted by 0x1f; shorter records drop out."""
    fields = F.split(F.ltrim(F.col("value"), F.lit("\n")), "\u001f", -1)
    rows = spark.read.option("lineSep", "\u001e").text(path).select(fields.alias("f")).where(F.size("f") >= 7)
    at = lambda i: F.trim(F.col("f")[i])
    return rows.select(
        at(0).alias("sha"), F.filter(F.split(at(1), " "), lambda p: p != "").alias("parents"), at(2).alias("author_name"), at(3).alias("author_email"), at(4).alias("authored_at"), at(5).alias("subject"), F.col("f")[6].alias("body")
    )


#: The series kept of a scrape.
SERIES = ("vllm:gpu_cache_usage_perc", "vllm:num_requests_running", "vllm:num_requests_waiting", "vllm:num_requests_swapped", "vllm:prompt_tokens_total", "vllm:generation_tokens_total")


def scraped_series(lines: DataFrame) -> DataFrame:
    """Sums over label sets of the kept series in scraped text (scrape, value)."""
    shape = r"^([A-Za-z_:][\w:]*)(?:\{[^}]*\})?\s+([-+0-9.eE]+|NaN)"
    rows = lines.where(~F.col("value").startswith("#")).select("scrape", F.regexp_extract("value", shape, 1).alias("series"), F.regexp_extract("value", shape, 2).try_cast("double").alias("v"))
    return rows.where(F.col("series").isin(*SERIES)).groupBy("scrape", "series").agg(F.sum("v").alias("value"))


#: The names under which each field of an imported record is known, in order of preference.
GYM_ALIASES = {
    "instance_id": ("instance_id", "id", "task_id", "instanceId"),
    "problem_statement": ("problem_statement", "problem", "instruction", "issue"),
    "fail_to_pass": ("FAIL_TO_PASS", "fail_to_pass", "f2p"),
    "pass_to_pass": ("PASS_TO_PASS", "pass_to_pass", "p2p"),
    "test_cmds": ("test_cmds", "test_cmd", "test_command"),
    "image": ("image", "docker_image", "instance_image"),
    "base_commit": ("base_commit", "baseCommit"),
    "test_patch": ("test_patch", "testPatch"),
    "gold_patch": ("patch", "gold_patch", "fix_patch"),
    "repo": ("repo", "repo_name"),
    "language": ("language", "lang"),
}


def gym_records(lines: DataFrame) -> DataFrame:
    """Normalised records of imported JSON lines (value): each field from the first alias that isn't empty.

    Lists come as arrays, as JSON in a string, or as one plain string.
    """
    v = F.try_parse_json("value")
    rows = lines.select(v.alias("v")).where(F.col("v").isNotNull())
    text = lambda k: F.nullif(F.nullif(F.try_variant_get(F.col("v"), f"$.{k}", "string"), F.lit("")), F.lit("[]"))
    first = lambda names: F.coalesce(*(text(k) for k in names))

    def listed(names: tuple[str, ...]) -> Column:
        s = first(names)
        return F.coalesce(F.when(s.rlike(r"^\s*\["), F.from_json(s, "array<string>")), F.when(s.isNotNull(), F.array(s)), F.array().cast("array<string>"))

    lists = ("fail_to_pass", "pass_to_pass", "test_cmds")
    return rows.select(*(first(a).alias(k) for k, a in GYM_ALIASES.items() if k not in lists), *(listed(GYM_ALIASES[k]).alias(k) for k in lists))


def unimportable_reason() -> Column:
    """Why a normalised record can't become a task; null if it can."""
    return (
        F.when(F.col("image").isNull(), "no_image")
        .when(F.size("fail_to_pass") == 0, "no_fail_to_pass")
        .when(F.col("base_commit").isNull(), "no_base_commit")
        .when(F.col("test_patch").isNull(), "no_test_patch")
        .when((F.size("test_cmds") == 0) & ~F.coalesce(F.lower("language").isin("python", "go", "rust", "javascript", "typescript"), F.lit(False)), "no_test_command")
    )


def captured_completions(lines: DataFrame) -> DataFrame:
    """Token ids, text and finish of recorded responses (value), wherever the server put them; a row without ids is marked."""
    v = F.try_parse_json("value")
    rows = lines.select(v.alias("v"))
    ids = lambda *paths: F.coalesce(*(F.try_variant_get("v", p, "array<int>") for p in paths))
    text = lambda *paths: F.coalesce(*(F.try_variant_get("v", p, "string") for p in paths))
    found = rows.select(
        ids("$.prompt_token_ids", "$.choices[0].prompt_token_ids", "$.choices[0].message.prompt_token_ids").alias("prompt_token_ids"),
        ids("$.token_ids", "$.choices[0].token_ids", "$.choices[0].message.token_ids").alias("token_ids"),
        text("$.choices[0].message.content", "$.choices[0].text").alias("text"),
        text("$.choices[0].message.reasoning_content", "$.choices[0].message.reasoning").alias("reasoning_text"),
        text("$.choices[0].finish_reason").alias("finish_reason"),
        text("$.model").alias("model"),
    )
    return found.withColumn("complete", F.col("prompt_token_ids").isNotNull() & F.col("token_ids").isNotNull())


def byte_table(vocab: DataFrame) -> DataFrame:
    """Bytes of byte-level vocabulary entries (token_id, token): printable letters stand for bytes, other tokens for their UTF-8."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    pairs = [(chr(b), b) for b in plain] + [(chr(256 + k), b) for k, b in enumerate(other)]
    letters = F.create_map(*(F.lit(x) for c, b in pairs for x in (c, f"{b:02x}")))
    codes = F.transform(F.split("token", ""), lambda c: F.try_element_at(letters, c))
    whole = F.forall(codes, lambda x: x.isNotNull())
    return vocab.select("token_id", F.when(whole, F.unhex(F.array_join(codes, ""))).otherwise(F.encode("token", "UTF-8")).alias("bytes"))
