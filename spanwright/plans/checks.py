"""Queries of gates, checks, renderings and round trips through files."""

from __future__ import annotations


from pyspark.sql import functions as F

from spanwright import streaming
from spanwright.operators import checks as C
from spanwright.operators import support as S
from spanwright.operators import trajectory as T
from spanwright.operators.mining import is_non_bug
from spanwright.plans import diagnosis, repositories, tokens, trajectories
from spanwright.plans.support import _strata
from spanwright.plans.views import oracle, rounded, view
from spanwright.runtime import materialize, scratch
from spanwright.sources import files, sinks


def _written(spark, df):
    """Lines as text files in the shared folder; their path."""
    path = scratch(spark, "lines")
    df.write.text(path)
    return path


def _lines(spark, sf_dir):
    k = F.col("o_orderkey")
    good = F.format_string('{"a": %d, "b": "x"}', k)
    return view(spark, sf_dir, "orders").select(F.when(k % 7 == 0, F.lit("{broken")).when(k % 11 == 0, F.lit("")).otherwise(good).alias("value"))


def q_a10_tolerant_lines(spark, sf_dir):
    return files.json_lines(spark, _written(spark, _lines(spark, sf_dir)), "a bigint, b string").where(F.col("a").isNotNull())


def q_a11_marked_lines(spark, sf_dir):
    kept = materialize(files.json_lines(spark, _written(spark, _lines(spark, sf_dir)), "a bigint, b string", "keep"), "marked")
    return kept.agg(F.count("*").alias("n"), F.count_if(F.col("_bad").isNotNull()).alias("bad"))


def q_a23_git_log(spark, sf_dir):
    """Customers as commits of a recorded log, every fifth cut short."""
    k = F.col("c_custkey").cast("string")
    full = F.concat_ws("\u001f", F.md5(k), F.when(F.col("c_custkey") % 2 == 0, F.lit("p q")).otherwise(F.lit("p")), F.col("c_name"), F.lit("a@x"), F.lit("2024"), F.concat(F.lit("subject "), k), F.lit("body"))
    record = F.concat(F.when(F.col("c_custkey") % 5 == 0, F.concat_ws("\u001f", k, F.lit("short"))).otherwise(full), F.lit("\u001e"))
    path = _written(spark, view(spark, sf_dir, "customer").select(record.alias("value")))
    return files.git_log(spark, path).select("sha", F.size("parents").alias("n_parents"), "author_name", "subject")


def q_b06_resumed_log(spark, sf_dir):
    """A log appended to twice holds each rollout once."""
    path = scratch(spark, "log")
    rows = view(spark, sf_dir, "v_rollouts").select("model", "task", "rollout_index", "passed")
    sinks.append_missing(rows.where("rollout_index <= 5"), path, ["model", "task", "rollout_index"])
    sinks.append_missing(rows, path, ["model", "task", "rollout_index"])
    return spark.read.parquet(path)


def q_b04_deficit_report(spark, sf_dir):
    from spanwright.plans.diagnosis import q_e01_deficit_scores

    evidence = view(spark, sf_dir, "v_labels").where("label = 'LACKING'").select("capability_id", F.concat(F.lit("note "), F.substring(F.md5("run_id"), 1, 1)).alias("evidence"))
    return sinks.deficit_report(q_e01_deficit_scores(spark, sf_dir).select("capability_id", "gap"), evidence)


def q_c09_tri_state(spark, sf_dir):
    curves = S.support_curves(_strata(spark, sf_dir))
    return curves.select("model", "task", S._outside(F.col("pass1"), F.col("n32"), F.col("c32")).alias("outside"), S._near_zero(F.col("pass1"), F.col("n32"), F.col("c32")).alias("near_zero"))


def q_c18_titles(spark, sf_dir):
    k = F.col("o_orderkey") % 9
    titles = ("Back-port the fix", "Handle release of locks", "Fix crash", "merge main into dev", "Sync stable", "Resync offsets", "re-sync offsets", "Merging results", "Bumpy road")
    title = F.coalesce(*(F.when(k == i, t) for i, t in enumerate(titles)))
    return view(spark, sf_dir, "orders").select("o_orderkey", is_non_bug(title).alias("non_bug"))


def q_c28_trusted(spark, sf_dir):
    k = F.col("o_orderkey")
    row = view(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 9 != 0, (k % 2).cast("double")).alias("reward"), F.when(k % 5 == 0, "no_model_patch").alias("ps"), F.when(k % 7 == 0, False).when(k % 7 == 1, True).alias("tw"), (k % 4 == 0).alias("to"))
    return row.select("o_orderkey", C.trusted_pass(F.col("reward"), F.col("ps"), F.col("tw"), F.col("to")).alias("passed"))


def q_c32_probe(spark, sf_dir):
    k = F.col("s_suppkey")
    pairs = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit("github.com=000;pypi.org=000 refused")).otherwise(F.lit("github.com=000;pypi.org=200"))
    return view(spark, sf_dir, "supplier").select("s_suppkey", C.all_blocked(pairs).alias("blocked"))


def q_c37_planted_match(spark, sf_dir):
    k = F.col("p_partkey") % 5
    text = F.coalesce(*(F.when(k == i, t) for i, t in enumerate(("error_handling ADAPTS plan", "stderr only", "retry loop", "Formats output", "reads the traceback"))))
    return view(spark, sf_dir, "part").select("p_partkey", C.planted_match(text).alias("kind"))


def q_c41_tokenizers(spark, sf_dir):
    k = F.col("s_suppkey")
    side = lambda a, b, c: F.struct(a.alias("size"), b.alias("merges"), c.alias("vocab"))
    none = F.lit(None).cast("string")
    left = side(F.when(k % 2 == 0, F.lit("1")), F.when(k % 3 == 0, F.lit("m")), F.when(k % 5 != 0, F.lit("v")))
    right = side(F.when(k % 2 == 0, F.when(k % 4 == 0, F.lit("1")).otherwise(F.lit("2"))), F.when(k % 3 == 0, none).otherwise(none), F.when(k % 5 != 0, F.lit("v")))
    return view(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(C.tokenizer_problems(left, right), ",").alias("problems"))


def q_c43_proofs(spark, sf_dir):
    k = F.col("s_suppkey")
    return view(spark, sf_dir, "supplier").select("s_suppkey", C.valid_proof(k % 2 == 0, F.when(k % 3 != 0, k % 5 == 0)).alias("valid"), ((k % 20 - 10) / 100 >= -0.05).alias("non_regression"))


def q_c44_echo(spark, sf_dir):
    lists = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") != 6, -F.col("l_discount"))).alias("lps"), F.count("*").alias("n"))
    return lists.select("l_orderkey", C.echo_shape_ok(F.col("lps"), F.col("n")).alias("ok"))


def q_d30_ordered_results(spark, sf_dir):
    """Results of a turn's calls in the calls' order: lines of an order arrive by part, called by line."""
    lines = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("turn"), F.col("l_linenumber").cast("string").alias("call_id"), F.col("l_partkey").alias("pos"))
    calls = view(spark, sf_dir, "lineitem").where("l_linenumber <> 2").select(F.col("l_orderkey").alias("turn"), F.col("l_linenumber").cast("string").alias("call_id"), F.col("l_linenumber").cast("int").alias("pos"))
    return C.ordered_results(lines, calls).select("turn", "call_id", "rank")


def q_d34_cell_keys(spark, sf_dir):
    cells = view(spark, sf_dir, "v_task_caps").withColumn("cell", F.concat_ws("::", "task", "capability"))
    return cells.select("cell", F.split_part("cell", F.lit("::"), F.lit(1)).alias("task"), F.split_part("cell", F.lit("::"), F.lit(2)).alias("capability"))


def q_e10_topk_coverage(spark, sf_dir):
    """Orders as captured positions, their lines as alternatives."""
    top = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("width"), F.count_if(F.col("l_linenumber") % 4 != 0).alias("keyed"))
    joined = view(spark, sf_dir, "orders").join(top, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rounded(joined.agg(F.count("*").alias("positions"), F.count("width").alias("with_topk"), F.sum("width").alias("alternatives"), F.array_join(F.array_sort(F.collect_set("width")).cast("array<string>"), ",").alias("widths"), (F.sum("keyed") / F.sum("width")).alias("keyed_share")))


def q_e11_capture_verdict(spark, sf_dir):
    steps = view(spark, sf_dir, "step_views").dropDuplicates(["step_key"]).where("source = 'agent'")
    return C.capture_verdict(steps.select(F.nullif("message", F.lit("")).alias("text"), F.nullif(F.trim("step_timestamp"), F.lit("")).alias("started"), F.when(F.col("completion_tokens") > 0, F.array(F.col("completion_tokens"))).alias("ids")))


def q_e14_run_totals(spark, sf_dir):
    """Token, step and run grain of a training log from one pass: lines, orders, customers."""
    rows = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    grouped = rows.groupingSets([["o_custkey", "l_orderkey"], ["o_custkey"], []], "o_custkey", "l_orderkey").agg(F.grouping_id().alias("g"), F.count("*").alias("tokens"), F.avg(F.nanvl("l_discount", F.lit(None).cast("double"))).alias("mean_loss"))
    return rounded(grouped.groupBy("g").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.max("mean_loss").alias("worst")), 7)


def q_e28_probe_stats(spark, sf_dir):
    rows = view(spark, sf_dir, "v_rollouts").where("passed IS NOT NULL")
    probes = rows.groupBy("task", F.floor(F.col("rollout_index") / 2).alias("probe")).agg(F.count_distinct("passed").alias("verdicts"), F.bool_or("passed").alias("ok"))
    return rounded(probes.groupBy("task").agg(F.count("*").alias("probes"), F.count_if(F.col("verdicts") > 1).alias("disagreed"), F.avg((F.col("verdicts") > 1).cast("double")).alias("share"), F.count_if("ok").alias("recoverable")))


def q_f12_top_alternatives(spark, sf_dir):
    lists = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), "l_linenumber")).alias("c"))
    return lists.select("l_orderkey", F.array_join(F.transform(F.slice(F.array_sort("c"), 1, 3), lambda x: x["l_linenumber"]).cast("array<string>"), ",").alias("top"))


def q_f16_label_spans(spark, sf_dir):
    """Supervised spans of each run's turns with their lengths in characters."""
    turns = T.once(view(spark, sf_dir, "turns")).where(F.col("run_id").isNotNull() & F.col("idx").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("idx", "turn_id", F.coalesce(F.length("content"), F.lit(0)).alias("n"), (F.col("role") == "assistant").alias("s"))))
    lists = turns.groupBy("run_id").agg(ordered.alias("t"))
    spans = C.label_spans(F.transform("t", lambda x: x["n"]), F.transform("t", lambda x: F.coalesce(x["s"], F.lit(False))))
    return lists.select("run_id", F.explode(spans).alias("x")).groupBy("run_id").agg(F.count("*").alias("spans"), F.sum(F.col("x.end") - F.col("x.start")).alias("supervised"), F.max("x.end").alias("last"))


def q_f20_verification_points(spark, sf_dir):
    k = F.col("s_suppkey").cast("int")
    largest = F.when(k % 6 != 0, k % 7)
    points = C.verification_points(largest, (8 + k % 3), F.array(F.lit(3), F.lit(5)), 2)
    return view(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(points.cast("array<string>"), ",").alias("points"))


def q_f21_dropped_turns(spark, sf_dir):
    lists = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), (F.col("l_partkey") % 50).cast("int").alias("p")))).alias("t"))
    return lists.select("l_orderkey", C.dropped_turns(F.transform("t", lambda x: x["q"]), F.transform("t", lambda x: x["p"]), 60).alias("dropped"))


def q_f22_left_truncation(spark, sf_dir):
    lists = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"))
    return lists.select("l_orderkey", F.array_join(F.when(F.size("ids") > 3, F.slice("ids", -3, 3)).otherwise(F.col("ids")).cast("array<string>"), ",").alias("ids"))


def q_g06_filter_then_limit(spark, sf_dir):
    """The first twenty records that can be imported, not those among the first twenty."""
    from spanwright.plans.records import _gym_lines

    records = files.gym_records(_gym_lines(spark, sf_dir)).where(files.unimportable_reason().isNull())
    return records.orderBy(F.substring("instance_id", 2, 20).cast("bigint")).limit(20).select("instance_id")


def q_g07_capped_tests(spark, sf_dir):
    from spanwright.plans.repositories import q_s10_pytest_status

    lists = q_s10_pytest_status(spark, sf_dir).where("status = 'PASSED'").groupBy("log_id").agg(F.array_sort(F.collect_list("test")).alias("t"))
    return lists.select("log_id", F.size("t").alias("n"), F.array_join(F.slice("t", 1, 3), ",").alias("first"))


def q_h01_paired_tasks(spark, sf_dir):
    runs = view(spark, sf_dir, "v_runs").where(F.col("task").isNotNull())
    of = lambda m: runs.where(F.col("model") == m).select("task")
    return of("teacher-v4").intersect(of("student-14b"))


def q_m07_blended(spark, sf_dir):
    rows = view(spark, sf_dir, "lineitem")
    return rounded(rows.groupBy("l_orderkey").agg(F.avg(F.col("l_tax") + 0.3 * F.col("l_discount")).alias("loss")))


def q_m05_budgets(spark, sf_dir):
    k = F.col("s_suppkey")
    return view(spark, sf_dir, "supplier").where("s_suppkey > 0").select("s_suppkey", (F.ceil(F.log2(k)) + 2).cast("int").alias("budget"), F.floor((k - 10) / 2).cast("int").alias("midpoint"))


def q_m15_mapped_mass(spark, sf_dir):
    from spanwright.plans.tokens import _candidates

    rows = _candidates(spark, sf_dir)
    return rows.groupBy("position").agg(F.bround(F.sum(F.when(F.col("mapped"), F.exp("t_lp")).otherwise(0.0)), 7).alias("mass"), F.count_if("mapped").alias("mapped"), F.count("*").alias("width"))


def q_m16_kv_capacity(spark, sf_dir):
    """Cache room of each served GPU in tokens, at 0.9 use and a fixed cost a token."""
    free = F.col("mem_total_mib") * 0.9 - F.lit(16_000)
    return view(spark, sf_dir, "serve_endpoints").select("endpoint", F.greatest(F.floor(free * 1024 * 1024 / F.lit(163_840)), F.lit(0)).alias("tokens"))


def q_m17_sizes(spark, sf_dir):
    size = F.regexp_extract("model", r"(?i)(\d+(?:\.\d+)?)b\b", 1)
    return view(spark, sf_dir, "traces").where(F.col("model").isNotNull()).groupBy("model").agg(F.max(F.nullif(size, F.lit("")).try_cast("double")).alias("billions"), F.max(F.least(F.greatest(F.length("model") * 100, F.lit(600)), F.lit(1200))).alias("timeout"))


def q_s01_shortened(spark, sf_dir):
    return view(spark, sf_dir, "v_turns").where(F.col("content").isNotNull()).select("turn_id", T.shortened(F.col("content"), 40).alias("short"))


def q_s09_targeted_commands(spark, sf_dir):
    k = F.col("p_partkey")
    command = F.coalesce(*(F.when(k % 5 == i, c) for i, c in enumerate(("pytest -q", "python -m pytest tests/x.py", "go test ./...", "npx jest --ci", "cargo test"))))
    tests = F.array(F.lit("tests/a.py"), F.lit("pkg/b_test.go"), F.lit("web/c.test.ts"), F.lit("my dir/d.py"))
    return view(spark, sf_dir, "part").select("p_partkey", C.targeted_command(command, tests).alias("command"))


def q_s23_rendered_chat(spark, sf_dir):
    turns = T.once(view(spark, sf_dir, "turns")).where(F.col("run_id").isNotNull() & F.col("idx").isNotNull())
    return C.rendered_chat(T.training_messages(turns)).select("run_id", F.md5("prompt").alias("md5"))


def q_s24_completions(spark, sf_dir):
    """Assistant turns rendered as completions and parsed again; some lose their end, their thinking mark or a call's name."""
    turns = T.once(view(spark, sf_dir, "turns")).where(F.col("role") == "assistant")
    calls = F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<id:string,name:string,args:string>>")), lambda c: C.rendered_call(F.coalesce(c["name"], F.lit("")), F.array(F.struct(F.lit("raw").alias("name"), F.coalesce(c["args"], F.lit("")).alias("value"), F.lit(True).alias("is_string")), F.struct(F.lit("n").alias("name"), F.lit("1").alias("value"), F.lit(False).alias("is_string")))))
    text = C.rendered_completion(F.col("thinking"), F.col("content"), calls)
    h = F.substring(F.md5(F.col("turn_id").cast("string")), 1, 1)
    broken = F.when(h == "0", F.substr(text, F.lit(1), F.length(text) - 3)).when(h == "1", F.replace(text, F.lit(C.THINK_END), F.lit(""))).when(h == "2", F.replace(text, F.lit("invoke name="), F.lit("invoke nam="))).otherwise(text)
    found = turns.select("turn_id", F.explode(F.array(broken)).alias("text")).select("turn_id", F.explode(F.array(C.parsed_completion(F.col("text")))).alias("c"))
    names = F.array_join(F.transform("c.calls", lambda x: x["name"]), ",")
    raw = F.array_join(F.transform("c.calls", lambda x: F.get_json_object(x["arguments"], "$.raw")), "\n")
    return found.select("turn_id", F.md5("c.reasoning").alias("reasoning"), F.md5("c.content").alias("content"), names.alias("names"), F.md5(raw).alias("raw"), F.col("c.error").alias("error"))


def q_s26_durations(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", C.duration_text(F.when(F.col("event_id") % 13 != 0, F.col("event_id") * 7)).alias("text"))


def q_t04_sweep_window(spark, sf_dir):
    rows = view(spark, sf_dir, "v_attempts")
    return rounded(rows.groupBy("task").agg(F.min("rollout_index").alias("start"), F.max(F.col("rollout_index") + F.col("elapsed_sec")).alias("end")), 6)


def q_j03_args_as_text(spark, sf_dir):
    """Arguments as JSON text unless they are text already."""
    calls = T.action_steps(T.once(view(spark, sf_dir, "turns")).where(F.col("run_id").isNotNull() & F.col("idx").isNotNull()))
    inner = F.when(F.col("args").startswith('"'), F.try_variant_get(F.try_parse_json("args"), "$", "string"))
    return calls.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("args").startswith('"')).alias("texts"), F.count(inner).alias("whole"))


def q_w01_ledger(spark, sf_dir):
    """Requests of a proxy: each is captured or in the ledger of failures, by endpoint."""
    rows = view(spark, sf_dir, "vllm_metrics").dropDuplicates(["metric_id"])
    return rows.groupBy("endpoint").agg(F.count("*").alias("requests"), F.count_if(F.col("error").isNull()).alias("captured"), F.count("error").alias("failed"))


def q_w06_replayed_once(spark, sf_dir):
    """Runs of a stream handled once each, though the stream is started twice."""
    path = scratch(spark, "replayed")
    for _ in range(2):
        streaming.replay_once(streaming.table_stream(spark, sf_dir, "traces"), ["run_id"], path, lambda df: df.where("run_id IS NOT NULL").select("run_id"))
    return spark.read.parquet(path)


def q_k01_sweep(spark, sf_dir):
    """The two-stage sweep in one table: counts, escalation, luck and support."""
    strata = S.support_class(S.with_luck(_strata(spark, sf_dir)))
    return strata.groupBy("model").agg(F.count("*").alias("tasks"), F.count_if((F.col("n1") > 0) & (F.col("c1") == 0)).alias("escalated"), F.count_if("luck").alias("luck"), F.count_if(F.col("support") == "in_support").alias("in_support"), F.sum(F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("rollouts"))


def q_k08_log_checks(spark, sf_dir):
    """Named checks over all artifacts: (name, ok)."""
    gpu, metrics, steps = view(spark, sf_dir, "gpu_log"), view(spark, sf_dir, "vllm_metrics"), view(spark, sf_dir, "step_views")
    named = lambda df, name, ok: df.agg(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"))
    return (
        named(gpu, "gpu_log_has_samples", F.count("*") > 0)
        .unionByName(named(gpu, "gpu_errors_are_rare", F.avg(F.col("error").isNotNull().cast("double")) < 0.05))
        .unionByName(named(gpu, "gpu_was_busy", F.max(F.when(F.col("gpu_util_pct").between(0, 100), F.col("gpu_util_pct"))) >= 90))
        .unionByName(named(metrics, "metrics_have_rates", F.count("tokens_per_sec") > 0))
        .unionByName(named(steps, "all_steps_have_endpoints", F.count_if(F.col("endpoint").isNull()) == 0))
    )


def q_r01_example_source(spark, sf_dir):
    """Where the training example of each passed rollout comes from: its capture, else its text."""
    passed = view(spark, sf_dir, "v_rollouts").where("passed").select("model", "task", "rollout_index")
    captured = passed.where(F.col("rollout_index") % 3 != 0).select("model", "task", "rollout_index", F.lit(True).alias("captured"))
    return passed.join(captured, ["model", "task", "rollout_index"], "left").groupBy("model", F.when(F.col("captured"), "capture").otherwise("text").alias("source")).agg(F.count("*").alias("n"))


def q_r13_any_sample(spark, sf_dir):
    lists = view(spark, sf_dir, "v_rollouts").where("passed IS NOT NULL").groupBy("model", "task").agg(F.collect_list("passed").alias("s"))
    return lists.select("model", "task", F.exists("s", lambda x: x).alias("any"), F.forall("s", lambda x: x).alias("all"))


_LINE = "l AS (SELECT o_orderkey AS k FROM orders)"
_ONCE = r"t AS (SELECT *, CASE WHEN lower(trim(role, E' \t\n\r')) = 'agent' THEN 'assistant' ELSE lower(trim(role, E' \t\n\r')) END AS r FROM {v_turns} WHERE run_id IS NOT NULL AND idx IS NOT NULL)"
_COUNT = "counts AS (SELECT model, task, stratum, count(*) AS n, count(*) FILTER (passed) AS c FROM {v_rollouts} WHERE passed IS NOT NULL GROUP BY 1, 2, 3), strata AS (SELECT model, task, max(n) FILTER (stratum = 'stage1') AS n1, max(c) FILTER (stratum = 'stage1') AS c1, max(n) FILTER (stratum = 'stage2') AS n2, max(c) FILTER (stratum = 'stage2') AS c2 FROM counts GROUP BY 1, 2)"

QUERIES = {name: f for name, f in dict(globals()).items() if name.startswith("q_")}
SQL = {
    "q_a10_tolerant_lines": f"WITH {_LINE} SELECT k AS a, 'x' AS b FROM l WHERE k % 7 <> 0 AND k % 11 <> 0",
    "q_a11_marked_lines": f"WITH {_LINE} SELECT count(*) FILTER (k % 7 = 0 OR k % 11 <> 0) AS n, count(*) FILTER (k % 7 = 0) AS bad FROM l",
    "q_a23_git_log": "SELECT md5(CAST(c_custkey AS VARCHAR)) AS sha, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n_parents, c_name AS author_name, concat('subject ', c_custkey) AS subject FROM customer WHERE c_custkey % 5 <> 0",
    "q_b06_resumed_log": "SELECT model, task, rollout_index, passed FROM {v_rollouts}",
    "q_c09_tri_state": f"WITH {_COUNT}, u AS (SELECT model, task, CASE WHEN coalesce(n2, 0) > 0 THEN c2 ELSE c1 END AS c, coalesce(n2, 0) AS n32, c2 FROM strata) SELECT model, task, CASE WHEN n32 > 0 THEN c2 = 0 WHEN c > 0 THEN false END AS outside, CASE WHEN n32 > 0 THEN c2 * 32 <= n32 WHEN c > 0 THEN false END AS near_zero FROM u",
    "q_c18_titles": "SELECT o_orderkey, o_orderkey % 9 IN (0, 1, 3, 4, 5, 6) AS non_bug FROM orders",
    "q_c28_trusted": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN false WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 2 = 1 END AS passed FROM orders",
    "q_c32_probe": "SELECT s_suppkey, s_suppkey % 3 = 1 AS blocked FROM supplier",
    "q_c37_planted_match": "SELECT p_partkey, ['strict', 'near', 'near', 'none', 'strict'][CAST(p_partkey % 5 AS INT) + 1] AS kind FROM part",
    "q_c41_tokenizers": "SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN 'size_differs' END, CASE WHEN s_suppkey % 3 = 0 THEN 'merges_one_sided' END, CASE WHEN s_suppkey % 2 <> 0 AND s_suppkey % 5 = 0 THEN 'nothing_compared' END) AS problems FROM supplier",
    "q_c43_proofs": "SELECT s_suppkey, s_suppkey % 2 = 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 5 <> 0) AS valid, s_suppkey % 20 >= 5 AS non_regression FROM supplier",
    "q_c44_echo": "SELECT l_orderkey, count(*) FILTER (l_linenumber = 6) = 0 AS ok FROM lineitem GROUP BY 1",
    "q_d30_ordered_results": "WITH r AS (SELECT l_orderkey AS turn, l_linenumber, l_partkey AS pos, CASE WHEN l_linenumber <> 2 THEN l_linenumber ELSE 0 END AS cp FROM lineitem) SELECT turn, CAST(l_linenumber AS VARCHAR) AS call_id, CAST(row_number() OVER (PARTITION BY turn ORDER BY cp, pos) - 1 AS INT) AS rank FROM r",
    "q_d34_cell_keys": "SELECT concat(task, '::', capability) AS cell, task, capability FROM {v_task_caps}",
    "q_e10_topk_coverage": "WITH w AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber % 4 <> 0) AS k FROM lineitem GROUP BY 1), j AS (SELECT * FROM orders LEFT JOIN w ON w.l_orderkey = o_orderkey) SELECT count(*) AS positions, count(n) AS with_topk, CAST(sum(n) AS BIGINT) AS alternatives, (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FROM (SELECT DISTINCT n FROM w)) AS widths, round(sum(k) / sum(n), 9) AS keyed_share FROM j",
    "q_e11_capture_verdict": "WITH s AS (SELECT DISTINCT ON (step_key) * FROM step_views WHERE source = 'agent'), c AS (SELECT count(*) AS n, count(*) FILTER (message IS NULL OR message = '') AS no_text, count(*) FILTER (step_timestamp IS NULL OR trim(step_timestamp) = '') AS no_start, count(*) FILTER (NOT coalesce(completion_tokens > 0, false)) AS no_ids FROM s) SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN no_ids > 0 THEN 'unusable' WHEN no_text > 0 OR no_start > 0 THEN 'partial' ELSE 'complete' END AS verdict FROM c",
    "q_e14_run_totals": "WITH r AS (SELECT o_custkey, l_orderkey, grouping(o_custkey, l_orderkey) AS g, count(*) AS tokens, avg(l_discount) AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY GROUPING SETS ((o_custkey, l_orderkey), (o_custkey), ())) SELECT g, count(*) AS \"rows\", CAST(sum(tokens) AS BIGINT) AS tokens, round(max(m), 7) AS worst FROM r GROUP BY 1",
    "q_e28_probe_stats": "WITH p AS (SELECT task, rollout_index // 2 AS probe, count(DISTINCT passed) AS v, bool_or(passed) AS ok FROM {v_rollouts} WHERE passed IS NOT NULL GROUP BY 1, 2) SELECT task, count(*) AS probes, count(*) FILTER (v > 1) AS disagreed, round(avg(CAST(v > 1 AS INT)), 9) AS share, count(*) FILTER (ok) AS recoverable FROM p GROUP BY 1",
    "q_f12_top_alternatives": "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY 1",
    "q_f16_label_spans": f"WITH {_ONCE}, c AS (SELECT run_id, r, coalesce(length(content), 0) AS n, sum(coalesce(length(content), 0)) OVER (PARTITION BY run_id ORDER BY idx, turn_id ROWS UNBOUNDED PRECEDING) AS e FROM t) SELECT run_id, count(*) AS spans, CAST(sum(n) AS BIGINT) AS supervised, CAST(max(e) AS INT) AS last FROM c WHERE r = 'assistant' GROUP BY 1",
    "q_f21_dropped_turns": "WITH r AS (SELECT l_orderkey, row_number() OVER w AS k, sum(CAST(l_quantity AS INT)) OVER v AS a, sum(CAST(l_partkey % 50 AS INT)) OVER v AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INT), l_partkey % 50), v AS (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INT), l_partkey % 50 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT l_orderkey, CAST(count(*) - count(*) FILTER (a <= 60 AND b <= 60) AS INT) AS dropped FROM r GROUP BY 1",
    "q_f22_left_truncation": "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS k FROM lineitem) SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS ids FROM r WHERE k <= 3 GROUP BY 1",
    "q_g06_filter_then_limit": "SELECT concat('i', o_orderkey) AS instance_id FROM orders WHERE o_orderkey % 101 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 IN (1, 2, 3) AND o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0 ORDER BY o_orderkey LIMIT 20",
    "q_h01_paired_tasks": "SELECT task FROM {v_runs} WHERE task IS NOT NULL AND model = 'teacher-v4' INTERSECT SELECT task FROM {v_runs} WHERE model = 'student-14b'",
    "q_m07_blended": "SELECT l_orderkey, round(avg(l_tax + 0.3 * l_discount), 9) AS loss FROM lineitem GROUP BY 1",
    "q_m05_budgets": "SELECT s_suppkey, CAST(ceil(log2(s_suppkey)) + 2 AS INT) AS budget, CAST(floor((s_suppkey - 10) / 2) AS INT) AS midpoint FROM supplier WHERE s_suppkey > 0",
    "q_m16_kv_capacity": "SELECT endpoint, CAST(greatest(floor((mem_total_mib * 0.9 - 16000) * 1024 * 1024 / 163840), 0) AS BIGINT) AS tokens FROM serve_endpoints",
    "q_m17_sizes": "SELECT model, max(TRY_CAST(nullif(regexp_extract(model, '(?i)([0-9]+(?:\\.[0-9]+)?)b\\b', 1), '') AS DOUBLE)) AS billions, CAST(max(least(greatest(length(model) * 100, 600), 1200)) AS INT) AS timeout FROM traces WHERE model IS NOT NULL GROUP BY 1",
    "q_s01_shortened": "SELECT turn_id, CASE WHEN length(content) > 40 THEN concat(substr(content, 1, 40), '...') ELSE content END AS short FROM {v_turns} WHERE content IS NOT NULL",
    "q_s09_targeted_commands": "SELECT p_partkey, ['pytest -q tests/a.py ''my dir/d.py''', 'python -m pytest tests/x.py', 'go test ./pkg', 'npx jest --ci web/c.test.ts', 'cargo test'][CAST(p_partkey % 5 AS INT) + 1] AS command FROM part",
    "q_s23_rendered_chat": f"WITH {_ONCE} SELECT run_id, md5(string_agg(concat('<|', r, '|>', chr(10), coalesce(content, ''), '<|end|>', chr(10)), '' ORDER BY idx, turn_id)) AS md5 FROM t WHERE coalesce(subagent_depth, 0) = 0 AND NOT (r = 'system' AND coalesce(starts_with(content, '[subagent'), false)) GROUP BY 1",
    "q_f20_verification_points": f"SELECT s_suppkey, array_to_string({trajectories._points('largest', 'steps', '[3, 5]')}, ',') AS points FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 6 <> 0 THEN CAST(s_suppkey % 7 AS INT) END AS largest, CAST(8 + s_suppkey % 3 AS INT) AS steps FROM supplier)",
    "q_j03_args_as_text": f"WITH {trajectories._STEPS}, a AS (SELECT c.name AS name, c.args AS args FROM calls) SELECT name, count(*) AS n, count(*) FILTER (starts_with(args, '\"')) AS texts, count(*) FILTER (starts_with(args, '\"') AND json_valid(args)) AS whole FROM a GROUP BY 1",
    "q_s24_completions": r"""WITH t AS (SELECT turn_id, coalesce(thinking, '') AS r, coalesce(content, '') AS c, coalesce(tool_calls, []) AS k, substr(md5(CAST(turn_id AS VARCHAR)), 1, 1) AS h FROM {v_turns} WHERE lower(trim(role, E' \t\n\r')) IN ('agent', 'assistant')),
e AS (SELECT *, CASE WHEN h = '1' THEN 'thinking' WHEN h = '0' AND len(k) = 0 THEN 'end' WHEN h IN ('0', '2') AND len(k) > 0 THEN 'tool_calls' END AS error FROM t)
SELECT turn_id, CASE WHEN error IS NULL THEN md5(r) END AS reasoning, CASE WHEN error IS NULL THEN md5(c) END AS content, CASE WHEN error IS NULL THEN array_to_string(list_transform(k, lambda x: coalesce(x.name, '')), ',') END AS names,
  CASE WHEN error IS NULL THEN md5(array_to_string(list_transform(k, lambda x: coalesce(x.args, '')), chr(10))) END AS raw, error FROM e""",
    "q_s26_durations": "WITH e AS (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN event_id * 7 END AS s FROM events) SELECT event_id, CASE WHEN s IS NULL THEN '-' WHEN s >= 3600 THEN concat(s // 3600, 'h ', lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0'), 'm') WHEN s >= 60 THEN concat(s // 60, 'm ', lpad(CAST(s % 60 AS VARCHAR), 2, '0'), 's') ELSE concat(s, '.0s') END AS text FROM e",
    "q_t04_sweep_window": "SELECT task, min(rollout_index) AS start, round(max(rollout_index + elapsed_sec), 6) AS \"end\" FROM {v_attempts} GROUP BY 1",
    "q_w01_ledger": "WITH m AS (SELECT DISTINCT ON (metric_id) * FROM vllm_metrics) SELECT endpoint, count(*) AS requests, count(*) FILTER (error IS NULL) AS captured, count(error) AS failed FROM m GROUP BY 1",
    "q_w06_replayed_once": "SELECT DISTINCT run_id FROM traces WHERE run_id IS NOT NULL",
    "q_k01_sweep": f"WITH {_COUNT} SELECT model, count(*) AS tasks, count(*) FILTER (n1 > 0 AND c1 = 0) AS escalated, count(*) FILTER (c2 > 0 AND (n1 IS NULL OR (n1 > 0 AND c1 = 0))) AS luck, count(*) FILTER (coalesce(c1, 0) + coalesce(c2, 0) > 0) AS in_support, CAST(sum(coalesce(n1, 0) + coalesce(n2, 0)) AS BIGINT) AS rollouts FROM strata GROUP BY 1",
    "q_k08_log_checks": "SELECT 'gpu_log_has_samples' AS name, count(*) > 0 AS ok FROM gpu_log UNION ALL SELECT 'gpu_errors_are_rare', avg(CAST(error IS NOT NULL AS INT)) < 0.05 FROM gpu_log UNION ALL SELECT 'gpu_was_busy', max(gpu_util_pct) FILTER (gpu_util_pct BETWEEN 0 AND 100) >= 90 FROM gpu_log UNION ALL SELECT 'metrics_have_rates', count(tokens_per_sec) > 0 FROM vllm_metrics UNION ALL SELECT 'all_steps_have_endpoints', count(*) FILTER (endpoint IS NULL) = 0 FROM step_views",
    "q_r01_example_source": "SELECT model, CASE WHEN rollout_index % 3 <> 0 THEN 'capture' ELSE 'text' END AS source, count(*) AS n FROM {v_rollouts} WHERE passed GROUP BY 1, 2",
    "q_r13_any_sample": "SELECT model, task, bool_or(passed) AS \"any\", bool_and(passed) AS \"all\" FROM {v_rollouts} WHERE passed IS NOT NULL GROUP BY 1, 2",
}
_EVIDENCE = "SELECT capability_id, left(array_to_string(list_sort(list(DISTINCT concat('note ', substr(md5(run_id), 1, 1)))), ' '), 800) AS summary FROM {v_labels} WHERE label = 'LACKING' GROUP BY 1"
SQL |= {
    "q_b04_deficit_report": f"{diagnosis.RAW_SCORES} SELECT s.capability_id, round(gap, 9) AS gap, e.summary FROM scored s LEFT JOIN ({_EVIDENCE}) e ON e.capability_id = s.capability_id",
    "q_m15_mapped_mass": f"WITH {tokens._CAND} SELECT position, round_even(coalesce(sum(exp(t)) FILTER (m), 0), 7) AS mass, count(*) FILTER (m) AS mapped, count(*) AS width FROM cand GROUP BY 1",
    "q_g07_capped_tests": f"WITH {repositories._LINES}, {repositories._pytest('lines', 'st')}, l AS (SELECT log_id, list_sort(list(test)) AS t FROM st WHERE status = 'PASSED' GROUP BY 1) SELECT log_id, CAST(len(t) AS INT) AS n, array_to_string(t[1:3], ',') AS first FROM l",
}
SQL = {name: oracle(text) for name, text in SQL.items()}
