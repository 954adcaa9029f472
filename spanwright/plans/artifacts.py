"""Queries of discovery, provenance and verdicts over recorded artifacts."""

from __future__ import annotations


from pyspark.sql import functions as F

from spanwright.functions import text as X
from spanwright.functions.telemetry import iso_micros
from spanwright.operators import artifacts as A
from spanwright.operators import support as S
from spanwright.operators import telemetry as M
from spanwright.plans.support import _rates
from spanwright.plans.views import oracle, rounded, view
from spanwright.runtime import scratch
from spanwright.sources import files, recorded, sinks


def q_a07_trajectory(spark, sf_dir):
    """Of each order's files the one in a folder ``agent``, of those the newest."""
    lines = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_shipdate").alias("modified"), F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.lit("agent/")).otherwise(F.lit("x/")), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("path"))
    return files.newest(lines, "job", (~F.col("path").startswith("agent/")).cast("int")).select("job", "path")


def q_a08_step_flags(spark, sf_dir):
    steps = view(spark, sf_dir, "step_views").dropDuplicates(["step_key"])
    thinks = F.coalesce(F.col("message").contains("<think>"), F.lit(False))
    return steps.groupBy("source").agg(F.count("*").alias("n"), F.count_if(thinks).alias("thinks"), F.count_if(F.coalesce("observation_text", F.lit("")) != "").alias("observed"), F.sum("prompt_tokens").alias("prompt"))


def q_a09_episodes(spark, sf_dir):
    """Numbers of summary episodes in file names, and the last one of each folder."""
    names = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.concat(F.lit("trajectory.summarization-"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, F.lit("-questions.json")).otherwise(F.lit("-answers.json"))).alias("name"))
    number = F.regexp_extract("name", r"^trajectory\.summarization-(\d+)-questions\.json$", 1).try_cast("int")
    return names.select("job", number.alias("n")).where(F.col("n").isNotNull()).groupBy("job").agg(F.count("*").alias("episodes"), F.max("n").alias("last"))


def q_a14_metrics_frame(spark, sf_dir):
    rows = M.metrics_frame(view(spark, sf_dir, "vllm_metrics"))
    return rounded(rows.groupBy("endpoint").agg(F.count("*").alias("n"), F.max("kv_used_frac").alias("top_kv"), F.min("us").alias("first_us")))


def q_a15_light_captures(spark, sf_dir):
    from pyspark.sql import Window

    steps = view(spark, sf_dir, "step_views").dropDuplicates(["step_key"]).where("source = 'agent'")
    order = Window.partitionBy("trial_id").orderBy(F.asc_nulls_last("prompt_tokens"), "step_key")
    return steps.select("trial_id", "step_key", (F.row_number().over(order) - 1).alias("ordinal"), (F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("tokens"))


def q_a17_trials(spark, sf_dir):
    steps = view(spark, sf_dir, "step_views")
    scan = lambda cond: steps.where(cond).select(F.col("trial_id").alias("trial"))
    return A.discovered_trials(scan("source = 'agent'"), scan("first_command_preview IS NOT NULL"), scan("endpoint IS NULL"))


def q_a20_passing_rollouts(spark, sf_dir):
    rows = view(spark, sf_dir, "v_rollouts").where("passed").select("task", "model", "rollout_index")
    log, report = rows.where("rollout_index % 5 = 0"), rows.where("model = 'teacher'")
    return A.preferred_source(log, report, "task").groupBy("task").agg(F.count("*").alias("n"))


def q_a21_recorded_prs(spark, sf_dir):
    """Orders as recorded pull requests, read back through the data source."""
    recorded.register(spark)
    path = scratch(spark, "prs")
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(k.alias("number"), F.lit("t").alias("title"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("merged_at"), F.when(k % 3 != 0, F.lit("b")).alias("base_sha"), (k % 5 == 0).alias("is_draft")))
    view(spark, sf_dir, "orders").select(body.alias("value")).write.text(path)
    found = spark.read.format("recorded_prs").option("path", path).option("pattern", "part-*").option("since", "1996-01-01").option("until", "1996-12-31").load()
    return found.select("number", "merged_at")


def q_a25_bridge(spark, sf_dir):
    ids = F.concat_ws(",", F.collect_list(F.concat(F.lit('"'), F.col("p_partkey").cast("string"), F.lit('":"'), F.lower(F.hex("p_brand")), F.lit('"'))))
    maps = view(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 1000).alias("bucket")).agg(F.concat(F.lit("{"), ids, F.lit("}")).alias("value")).select(F.concat(F.lit("s"), F.col("bucket").cast("string")).alias("side"), "value")
    return A.bridge_bytes(maps).select("side", "token_id", F.col("bytes").cast("string").alias("text"))


def q_a31_cache_keys(spark, sf_dir):
    options = F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")))
    return view(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", F.left(F.md5("p_name"), F.lit(12)), F.left(F.sha2(options, 256), F.lit(8))).alias("key"))


def q_a33_seeded_subset(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat_ws(":", "doc_id", F.lit("5")))).limit(50)


def q_b15_report_round_trip(spark, sf_dir):
    """Rates written as a report and read back, the null ones too."""
    path = scratch(spark, "report")
    rates = view(spark, sf_dir, "v_rollouts").groupBy("model", "task").agg(F.try_divide(F.count_if("passed"), F.nullif(F.count_if(F.col("rollout_index") > 8), F.lit(0))).alias("rate"))
    sinks.write_report(rates, path)
    return rounded(spark.read.schema("model string, task string, rate double").json(path))


def q_d06_resolved_tasks(spark, sf_dir):
    """Lost runs' tasks that have no segment folder."""
    lost = view(spark, sf_dir, "v_runs").where("outcome = 'loss' AND task IS NOT NULL").select("task").distinct()
    return lost.join(view(spark, sf_dir, "segments").select("task").distinct(), "task", "left_anti")


def q_d09_label_matrix(spark, sf_dir):
    """How many runs each capability is judged on, and on how many it isn't."""
    runs = view(spark, sf_dir, "v_runs").count()
    labels = view(spark, sf_dir, "v_labels").groupBy("capability_id").agg(F.count_if(F.col("label") != "NA").alias("judged"))
    return labels.select("capability_id", "judged", (F.lit(runs) - F.col("judged")).alias("na"))


def q_d32_provenance(spark, sf_dir):
    k = F.col("s_suppkey")
    name = lambda i: F.concat(F.lit("t"), ((k + i) % 7).cast("string"), F.lit(".py::a"))
    tasks = view(spark, sf_dir, "supplier").select(k.alias("task"), F.array(name(0), name(1)).alias("declared"), F.array(F.concat(F.lit("t"), (k % 5).cast("string"), F.lit(".py"))).alias("patched"), F.array(name(1), F.when(k % 3 == 0, name(2)).otherwise(name(0))).alias("shipped"))
    return A.provenance(tasks)


def q_g08_pilot_cap(spark, sf_dir):
    return view(spark, sf_dir, "v_task_caps").select("task").distinct().orderBy(F.md5(F.concat_ws(":", "task", F.lit("0")))).limit(10)


def q_h05_strata(spark, sf_dir):
    """Both strata as one multiset."""
    rows = view(spark, sf_dir, "v_rollouts")
    one, two = rows.where("stratum = 'stage1'"), rows.where("stratum = 'stage2'")
    return one.unionByName(two).groupBy("model").agg(F.count("*").alias("n"), F.count("passed").alias("judged"))


def q_h06_patch_parts(spark, sf_dir):
    """Source and test halves of diffs made of two files."""
    from spanwright.operators.mining import diff_files

    k = F.col("p_partkey")
    block = lambda p: F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n+"), F.col("p_name"), F.lit("\n"))
    diffs = view(spark, sf_dir, "part").select(k.alias("id"), F.concat(block(F.lit("src/a.py")), F.when(k % 3 != 0, block(F.lit("tests/test_a.py"))).otherwise(F.lit(""))).alias("diff"))
    parts = diff_files(diffs).groupBy("id", "is_test").agg(F.sum(F.length("block")).alias("n"))
    return parts


def q_s07_files_in_patch(spark, sf_dir):
    diff = F.concat(F.lit("diff --git a/src/a b.py b/src/a b.py\n+x\ndiff --git a/"), F.col("p_brand"), F.lit(" b/"), F.col("p_brand"), F.lit("\n"))
    paths = F.array_distinct(F.transform(X.diff_blocks(diff), lambda b: X.diff_path(b, "b")))
    return view(spark, sf_dir, "part").select("p_partkey", F.array_join(paths, "|").alias("paths"))


def q_s17_shell_text(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "bash").when(k % 3 == 1, "Execute").otherwise("read")
    args = F.when(k % 2 == 0, F.concat(F.lit('{"command": "ls '), F.col("p_size").cast("string"), F.lit('"}'))).otherwise(F.lit('{"cmd": "", "input": "id"}'))
    return view(spark, sf_dir, "part").select("p_partkey", A.shell_text(name, args).alias("command"))


def q_s21_flat_messages(spark, sf_dir):
    k = F.col("p_partkey")
    message = F.when(k % 2 == 0, F.concat(F.lit('[{"type": "text", "text": "'), F.col("p_name"), F.lit('"}, {"type": "image"}, {"type": "audio"}]'))).otherwise(F.col("p_name"))
    return view(spark, sf_dir, "part").select("p_partkey", files.flat_message(message).alias("text"))


def q_s27_first_object(spark, sf_dir):
    text = F.concat(F.lit("Thought: x\nAction: "), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit('{"a": "'), F.col("p_brand"), F.lit('"} then {"b": 1}'))).otherwise(F.lit("none")))
    return view(spark, sf_dir, "part").select("p_partkey", A.first_json_object(text).alias("object"))


def q_m13_token_logprobs(spark, sf_dir):
    lists = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_tax") * 10).alias("x"), F.sum(F.exp(F.col("l_tax") * 10)).alias("z"))
    return rounded(lists.select("l_orderkey", (A.token_logprob(F.array_sort("x"), F.size("x") - 1)).alias("top")))


def q_m12_step_loss(spark, sf_dir):
    """Lines as spans: analytic, surrogate or dropped by their number."""
    n = F.col("l_linenumber")
    spans = view(spark, sf_dir, "lineitem").select("l_suppkey", F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").otherwise("DROP").alias("kind"), F.col("l_discount").alias("contribution"), (-F.col("l_tax")).alias("s_sum"), (-F.col("l_discount")).alias("t_sum"), n.alias("n_student"))
    return rounded(A.step_loss(spans))


def q_m06_effects(spark, sf_dir):
    """Difference of both arms' rates by task, and whether the slice could resolve it."""
    rates = _rates(spark, sf_dir)
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("rate")))
    both = rates.groupBy("task").agg((of("teacher") - of("student")).alias("delta"))
    return rounded(both.select("task", "delta", (F.abs("delta") >= 0.2).alias("resolvable")))


def q_k05_examples(spark, sf_dir):
    from spanwright.plans.trajectories import q_k02_bisection

    found = q_k02_bisection(spark, sf_dir).withColumn("verified", F.substring(F.md5("run_id"), 1, 1) != "0")
    return A.training_example(found).groupBy(F.col("prefix_steps").isNull().alias("none")).agg(F.count("*").alias("n"))


def q_k06_arm_table(spark, sf_dir):
    """Rates of all arms side by side: one grouping, not a join an arm."""
    rows = S.task_counts(view(spark, sf_dir, "v_rollouts"))
    of = lambda m, s: F.max(F.when((F.col("model") == m) & (F.col("stratum") == s), F.col("c") / F.col("n")))
    return rounded(rows.groupBy("task").agg(of("student", "stage1").alias("a0"), of("student", "stage2").alias("a1"), of("teacher", "stage1").alias("a2"), of("teacher", "stage2").alias("a3")))


def q_x09_command_resolved(spark, sf_dir):
    from spanwright.plans.repositories import q_d20_grade

    return q_d20_grade(spark, sf_dir).select("log_id", A.command_resolved(F.col("resolved"), F.col("untracked"), F.pmod("log_id", F.lit(3))).alias("ok"))


def q_x10_consistent_replay(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), n.alias("step"), (F.col("l_partkey") % 3 != 0).alias("checkable"), (F.col("l_suppkey") % 7 != 0).alias("same"))
    return A.consistent_replay(rows)


def q_r02_known_tasks(spark, sf_dir):
    return view(spark, sf_dir, "traces").where("task IS NOT NULL").join(view(spark, sf_dir, "segments").select("task").distinct(), "task", "left_semi").select("run_id", "ordinal")


def q_r04_datum(spark, sf_dir):
    lists = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"))
    padded, weights = A.datum(F.slice("ids", 1, 2), F.transform(F.slice("ids", 3, 9), lambda x: -x / F.lit(10.0)))
    return lists.select("l_orderkey", F.array_join(padded.cast("array<string>"), ",").alias("logprobs"), F.array_join(weights.cast("array<string>"), ",").alias("weights"))


def q_t01_iso_times(spark, sf_dir):
    """Instants of step timestamps; one without an offset is UTC."""
    return view(spark, sf_dir, "step_views").dropDuplicates(["step_key"]).select("step_key", iso_micros(F.col("step_timestamp")).alias("us"))


QUERIES = {name: f for name, f in dict(globals()).items() if name.startswith("q_")}
_COUNTS = "counts AS (SELECT model, task, stratum, count(*) AS n, count(*) FILTER (passed) AS c FROM {v_rollouts} WHERE passed IS NOT NULL GROUP BY 1, 2, 3)"
from spanwright.plans.repositories import SQL as _MINING_SQL  # noqa: E402
from spanwright.plans.trajectories import _BISECTION  # noqa: E402

SQL = {
    "q_k05_examples": f"{_BISECTION} SELECT prefix IS NULL AS none, count(*) AS n FROM (SELECT CASE WHEN NOT dropped AND substr(md5(run_id), 1, 1) <> '0' AND largest >= 0 THEN largest + 1 END AS prefix FROM bisected) GROUP BY 1",
    "q_r04_datum": "WITH g AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS ids FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_concat(list_transform(ids[1:2], lambda x: '0.0'), list_transform(ids[3:11], lambda x: CAST(-x / 10.0 AS VARCHAR))), ',') AS logprobs, array_to_string(list_concat(list_transform(ids[1:2], lambda x: 0), list_transform(ids[3:11], lambda x: 1)), ',') AS weights FROM g",
    "q_a07_trajectory": "WITH r AS (SELECT l_orderkey AS job, concat(CASE WHEN l_linenumber % 2 = 0 THEN 'agent/' ELSE 'x/' END, l_partkey, '-', l_linenumber) AS path, l_linenumber % 2 AS p, l_shipdate FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY p, l_shipdate DESC, path) AS rn FROM r) SELECT job, path FROM k WHERE rn = 1",
    "q_a08_step_flags": "WITH s AS (SELECT DISTINCT ON (step_key) * FROM step_views) SELECT source, count(*) AS n, count(*) FILTER (coalesce(contains(message, '<think>'), false)) AS thinks, count(*) FILTER (coalesce(observation_text, '') <> '') AS observed, CAST(sum(prompt_tokens) AS BIGINT) AS prompt FROM s GROUP BY 1",
    "q_a09_episodes": "SELECT l_orderkey AS job, count(*) AS episodes, CAST(max(l_linenumber) AS INT) AS last FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY 1",
    "q_a14_metrics_frame": "WITH m AS (SELECT DISTINCT ON (metric_id) * FROM vllm_metrics) SELECT endpoint, count(*) AS n, round(max(kv_used_frac), 9) AS top_kv, min(epoch_us(ts)) AS first_us FROM m GROUP BY 1",
    "q_a15_light_captures": "WITH s AS (SELECT DISTINCT ON (step_key) * FROM step_views WHERE source = 'agent') SELECT trial_id, step_key, CAST(row_number() OVER (PARTITION BY trial_id ORDER BY prompt_tokens NULLS LAST, step_key) - 1 AS INT) AS ordinal, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS tokens FROM s",
    "q_a17_trials": "WITH a AS (SELECT DISTINCT trial_id AS trial, 1 AS k FROM step_views WHERE source = 'agent' UNION SELECT DISTINCT trial_id, 2 FROM step_views WHERE first_command_preview IS NOT NULL UNION SELECT DISTINCT trial_id, 3 FROM step_views WHERE endpoint IS NULL) SELECT trial, count(*) AS kinds FROM a GROUP BY 1",
    "q_a20_passing_rollouts": "WITH p AS (SELECT task, model, rollout_index FROM {v_rollouts} WHERE passed), l AS (SELECT * FROM p WHERE rollout_index % 5 = 0), r AS (SELECT * FROM p WHERE model = 'teacher' AND task NOT IN (SELECT task FROM l)) SELECT task, count(*) AS n FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY 1",
    "q_a21_recorded_prs": "SELECT CAST(o_orderkey AS INT) AS number, strftime(o_orderdate, '%Y-%m-%d') AS merged_at FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'",
    "q_a25_bridge": "SELECT concat('s', p_partkey // 1000) AS side, CAST(p_partkey AS INT) AS token_id, p_brand AS text FROM part",
    "q_a31_cache_keys": """SELECT p_partkey, concat(left(md5(p_name), 12), '-', left(sha256(concat('{"size":', p_size, ',"brand":"', p_brand, '"}')), 8)) AS key FROM part""",
    "q_a33_seeded_subset": "SELECT doc_id FROM documents ORDER BY md5(concat(doc_id, ':5')) LIMIT 50",
    "q_b15_report_round_trip": "SELECT model, task, round(count(*) FILTER (passed) / nullif(count(*) FILTER (rollout_index > 8), 0), 9) AS rate FROM {v_rollouts} GROUP BY 1, 2",
    "q_d06_resolved_tasks": "SELECT DISTINCT task FROM {v_runs} WHERE outcome = 'loss' AND task IS NOT NULL AND task NOT IN (SELECT task FROM segments WHERE task IS NOT NULL)",
    "q_d09_label_matrix": "SELECT capability_id, count(*) FILTER (label <> 'NA') AS judged, (SELECT count(*) FROM {v_runs}) - count(*) FILTER (label <> 'NA') AS na FROM {v_labels} GROUP BY 1",
    "q_d32_provenance": "SELECT s_suppkey AS task, array_to_string(list_sort(list_filter([concat('t', s_suppkey % 7, '.py'), concat('t', (s_suppkey + 1) % 7, '.py')], lambda f: f <> concat('t', s_suppkey % 5, '.py'))), ',') AS orphans, s_suppkey % 3 <> 0 AS shipped_agrees FROM supplier",
    "q_g08_pilot_cap": "SELECT DISTINCT task FROM {v_task_caps} ORDER BY md5(concat(task, ':0')) LIMIT 10",
    "q_h05_strata": "SELECT model, count(*) AS n, count(passed) AS judged FROM {v_rollouts} GROUP BY 1",
    "q_h06_patch_parts": "SELECT p_partkey AS id, false AS is_test, length(p_name) + 35 AS n FROM part UNION ALL SELECT p_partkey, true, length(p_name) + 49 FROM part WHERE p_partkey % 3 <> 0",
    "q_s07_files_in_patch": "SELECT p_partkey, concat('src/a b.py|', p_brand) AS paths FROM part",
    "q_s17_shell_text": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN CASE WHEN p_partkey % 2 = 0 THEN concat('ls ', p_size) ELSE 'id' END END AS command FROM part",
    "q_s21_flat_messages": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, chr(10), '[image]') ELSE p_name END AS text FROM part",
    "q_s27_first_object": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN concat('{\"a\": \"', p_brand, '\"}') END AS object FROM part",
    "q_m13_token_logprobs": "SELECT l_orderkey, round(max(l_tax * 10) - ln(sum(exp(l_tax * 10))), 9) AS top FROM lineitem GROUP BY 1",
    "q_m12_step_loss": "SELECT round(sum(CASE l_linenumber % 3 WHEN 0 THEN l_discount WHEN 1 THEN (l_discount - l_tax) * -l_tax ELSE 0 END) / sum(CASE WHEN l_linenumber % 3 < 2 THEN l_linenumber ELSE 0 END), 9) AS loss, count(*) FILTER (l_linenumber % 3 = 0) AS a, count(*) FILTER (l_linenumber % 3 = 1) AS b, count(*) FILTER (l_linenumber % 3 = 2) AS dropped FROM lineitem",
    "q_m06_effects": "WITH r AS (SELECT task, model, count(*) FILTER (passed) / count(*) AS rate FROM {v_rollouts} WHERE passed IS NOT NULL GROUP BY 1, 2), b AS (SELECT task, max(rate) FILTER (model = 'teacher') - max(rate) FILTER (model = 'student') AS d FROM r GROUP BY 1) SELECT task, round(d, 9) AS delta, abs(d) >= 0.2 AS resolvable FROM b",
    "q_k06_arm_table": f"WITH {_COUNTS} SELECT task, round(max(c / n) FILTER (model = 'student' AND stratum = 'stage1'), 9) AS a0, round(max(c / n) FILTER (model = 'student' AND stratum = 'stage2'), 9) AS a1, round(max(c / n) FILTER (model = 'teacher' AND stratum = 'stage1'), 9) AS a2, round(max(c / n) FILTER (model = 'teacher' AND stratum = 'stage2'), 9) AS a3 FROM counts GROUP BY 1",
    "q_x10_consistent_replay": "SELECT l_orderkey AS run_id, bool_or(l_partkey % 3 <> 0) AS verified, bool_and(l_suppkey % 7 <> 0 OR l_partkey % 3 = 0) AS consistent, min(CASE WHEN l_partkey % 3 <> 0 AND l_suppkey % 7 = 0 THEN l_linenumber END) AS first_fault FROM lineitem GROUP BY 1",
    "q_r02_known_tasks": "SELECT run_id, ordinal FROM traces WHERE task IN (SELECT task FROM segments)",
    "q_t01_iso_times": r"WITH s AS (SELECT DISTINCT ON (step_key) step_key, trim(step_timestamp) AS b FROM step_views), p AS (SELECT step_key, TRY_CAST(regexp_replace(b, '(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$', '') AS TIMESTAMP) AS t, regexp_extract(b, '([+-])([0-9]{2}):?([0-9]{2})$', ['s', 'h', 'm']) AS o FROM s) SELECT step_key, epoch_us(t) - CASE WHEN o.s IN ('+', '-') THEN CASE o.s WHEN '+' THEN 1 ELSE -1 END * (TRY_CAST(o.h AS BIGINT) * 60 + TRY_CAST(o.m AS BIGINT)) * 60000000 ELSE 0 END AS us FROM p",
}
SQL = {name: oracle(text) for name, text in SQL.items()}
#: The command's own verdict on top of the grades'.
SQL["q_x09_command_resolved"] = f"WITH graded AS ({_MINING_SQL['q_d20_grade']}) SELECT log_id, resolved AND untracked = 0 AND log_id % 3 = 0 AS ok FROM graded"
