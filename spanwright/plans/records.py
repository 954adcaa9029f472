"""Queries of sources, sinks, records and planted corpora over shapes made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.operators import planted as P
from spanwright.operators import records as R
from spanwright.operators import trajectory as T
from spanwright.plans.views import oracle, rounded, view
from spanwright.sources import files, sinks


def q_e17_planted_ceiling(spark, sf_dir):
    """The published sweep: three sizes by three prevalences."""
    configs = spark.createDataFrame([(f"{n}w/{n}l@{p}", n, n, p) for n in (3, 6, 12) for p in (1.0, 0.6, 0.3)], "config string, n_wins int, n_losses int, prevalence double")
    return P.ceilings(P.oracle_labels(spark, P.planted_kinds(configs)))


def q_a35_planted_kinds(spark, sf_dir):
    """Corpora sized by the suppliers' numbers."""
    configs = view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("config"), (2 + F.col("s_suppkey") % 9).cast("int").alias("n_wins"), (1 + F.col("s_suppkey") % 7).cast("int").alias("n_losses"), (F.col("s_suppkey") % 4 / 4).alias("prevalence"))
    return P.planted_kinds(configs).groupBy("config", "kind").agg(F.count("*").alias("n"))


def q_a05_atif_turns(spark, sf_dir):
    """Turns written as trajectory steps and read back: a tool turn is the observation of its own step."""
    turns = T.once(view(spark, sf_dir, "turns")).where(F.col("run_id").isNotNull() & F.col("idx").isNotNull())
    result = F.struct(F.col("tool_call_id").alias("source_call_id"), F.coalesce("content", F.lit("")).alias("content"))
    tool = F.col("role") == "tool"
    step = F.struct(
        F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role")).alias("source"), F.when(~tool, F.col("content")).alias("message"), F.when(~tool, F.col("thinking")).alias("reasoning_content"),
        F.when(~tool, F.transform("tool_calls", lambda c: F.struct(c["id"].alias("tool_call_id"), c["name"].alias("function_name"), c["args"].alias("arguments")))).alias("tool_calls"),
        F.struct(F.when(tool, F.array(result)).alias("results")).alias("observation"),
    )
    steps = turns.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "turn_id", step.alias("s")))), lambda x: x["s"]).alias("steps"))
    return files.atif_turns(steps).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "tool").alias("tool"), F.max("idx").alias("last_idx"))


def q_a06_subagents(spark, sf_dir):
    """Files reached from each supplier over two references each, to the operator's depth."""
    n = view(spark, sf_dir, "supplier").count()
    key = F.col("s_suppkey")
    edges = view(spark, sf_dir, "supplier").select(key.alias("src"), F.explode(F.array((key * 7) % n + 1, (key * 3 + 5) % n + 1)).alias("dst"))
    roots = view(spark, sf_dir, "supplier").select(key.alias("root"))
    return files.reachable_files(roots, edges).groupBy("root").agg(F.count("*").alias("visits"), F.count_distinct("file").alias("files"), F.max("depth").alias("depth"))


def _gym_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    name = lambda i, *names: F.coalesce(*(F.when(k % len(names) == j, F.lit(n)) for j, n in enumerate(names)))
    quoted = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    pair = lambda n, v: F.concat(quoted(n), F.lit(": "), v)
    f2p = F.when(k % 5 == 0, F.lit("[]")).when(k % 5 == 1, F.lit('["t.py::a", "t.py::b"]')).when(k % 5 == 2, F.lit('"[\\"t.py::a\\"]"')).when(k % 5 == 3, F.lit('"t.py::only"')).otherwise(F.lit("null"))
    line = F.concat(
        F.lit("{"), F.concat_ws(", ", pair(name(0, "instance_id", "id", "task_id", "instanceId"), quoted(F.concat(F.lit("i"), k.cast("string")))), pair(name(1, "FAIL_TO_PASS", "fail_to_pass", "f2p"), f2p),
                                pair(name(2, "image", "docker_image"), F.when(k % 7 == 0, F.lit('""')).otherwise(F.lit('"img"'))), pair(F.lit("base_commit"), quoted(F.md5(k.cast("string")))), pair(name(3, "test_patch", "testPatch"), F.when(k % 11 == 0, F.lit("null")).otherwise(F.lit('"p"'))),
                                pair(name(4, "language", "lang"), F.when(k % 3 == 0, F.lit('"cobol"')).otherwise(F.lit('"python"')))), F.lit("}"))
    bad = F.when(k % 101 == 0, F.lit("{broken")).otherwise(line)
    return view(spark, sf_dir, "orders").select(bad.alias("value"))


def q_a19_gym_alias(spark, sf_dir):
    return files.gym_records(_gym_lines(spark, sf_dir)).select("instance_id", F.array_join("fail_to_pass", "|").alias("fail_to_pass"), "image", "test_patch", "language")


def q_c20_importable(spark, sf_dir):
    return files.gym_records(_gym_lines(spark, sf_dir)).groupBy(files.unimportable_reason().alias("reason")).agg(F.count("*").alias("n"))


def q_a27_scraped_series(spark, sf_dir):
    """Each scrape as exposition text with the running requests split over two labels."""
    rows = view(spark, sf_dir, "vllm_metrics").dropDuplicates(["metric_id"]).where(F.col("running").isNotNull() & F.col("gen_tokens_total").isNotNull())
    lines = F.array(
        F.lit("# HELP vllm:num_requests_running x"), F.concat(F.lit('vllm:num_requests_running{model="a"} '), F.col("running").cast("string")), F.lit('vllm:num_requests_running{model="b"} 1.0'),
        F.concat(F.lit("vllm:generation_tokens_total "), F.col("gen_tokens_total").cast("string")), F.lit("other_series 5"),
    )
    return rounded(files.scraped_series(rows.select(F.col("metric_id").alias("scrape"), F.explode(lines).alias("value"))))


def q_a28_captures(spark, sf_dir):
    """Responses with their ids in one of three places."""
    k = F.col("l_orderkey")
    ids = F.concat(F.lit("["), F.col("l_partkey").cast("string"), F.lit(", "), F.col("l_suppkey").cast("string"), F.lit("]"))
    body = (
        F.when(k % 4 == 0, F.concat(F.lit('{"prompt_token_ids": '), ids, F.lit(', "token_ids": [1], "choices": [{"text": "a", "finish_reason": "stop"}]}')))
        .when(k % 4 == 1, F.concat(F.lit('{"choices": [{"prompt_token_ids": '), ids, F.lit(', "token_ids": [1, 2], "message": {"content": "b"}}]}')))
        .when(k % 4 == 2, F.concat(F.lit('{"choices": [{"message": {"content": "c", "token_ids": [3], "prompt_token_ids": '), ids, F.lit("}}]}")))
        .otherwise(F.lit('{"choices": [{"text": "d"}]}'))
    )
    found = files.captured_completions(view(spark, sf_dir, "lineitem").select(body.alias("value")))
    return found.groupBy("text", "complete").agg(F.count("*").alias("n"), F.sum(F.size("prompt_token_ids")).alias("prompt"), F.sum(F.size("token_ids")).alias("tokens"), F.sum(F.element_at("prompt_token_ids", 1).cast("bigint")).alias("first_ids"))


def q_a26_byte_table(spark, sf_dir):
    """Names with their blanks in the vocabulary's letter, and every ninth with a letter outside it."""
    k = F.col("p_partkey")
    token = F.concat(F.lit("Ġ"), F.regexp_replace("p_name", " ", "Ġ"), F.when(k % 9 == 0, F.lit("日")).otherwise(F.lit("")))
    return files.byte_table(view(spark, sf_dir, "part").select(k.alias("token_id"), token.alias("token"))).select("token_id", F.lower(F.hex("bytes")).alias("bytes"))


def q_a29_newest(spark, sf_dir):
    """The listing of each task that is preferred (a known outcome) and newest."""
    rows = view(spark, sf_dir, "traces").where(F.col("task").isNotNull() & F.col("started_at").isNotNull()).select("task", F.col("started_at").alias("modified"), F.concat_ws("#", "run_id", F.lpad(F.col("ordinal").cast("string"), 9, "0")).alias("path"), "outcome")
    return files.newest(rows, "task", F.col("outcome").isNull().cast("int")).select("task", "path")


def q_b08_content_hash(spark, sf_dir):
    return view(spark, sf_dir, "part").select("p_partkey", sinks.content_hash(F.col("p_name"), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))).alias("sha"))


def q_d25_manifest_drift(spark, sf_dir):
    part = view(spark, sf_dir, "part")
    k = F.col("p_partkey")
    first = part.where(k % 5 != 0).select(k.alias("path"), F.when(k % 7 != 0, F.col("p_brand")).alias("hash"))
    second = part.where(k % 6 != 0).select(k.alias("path"), F.when(k % 7 != 0, F.when(k % 8 == 0, F.lit("changed")).otherwise(F.col("p_brand"))).alias("hash"))
    return sinks.drifted(first, second, "path", "hash").select("path")


def q_d10_resume_antijoin(spark, sf_dir):
    """Pairs of task and model that a manifest doesn't list yet."""
    runs = view(spark, sf_dir, "v_runs").where(F.col("task").isNotNull() & F.col("model").isNotNull()).select("task", "model").distinct()
    models = runs.agg(F.collect_set("model").alias("every"))  # one row: the few models of a sweep
    done = runs.groupBy("task").agg(F.collect_set("model").alias("done"))
    return done.crossJoin(models).select("task", F.explode(F.array_except("every", "done")).alias("model"))


def q_d33_cache_conflicts(spark, sf_dir):
    return R.conflicting_keys(view(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_partkey"))


def q_d31_id_runs(spark, sf_dir):
    """Where the second and third line of an order stand among all its lines' remainders."""
    lists = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 3).cast("int").alias("m")))), lambda x: x["m"]).alias("ids"))
    return lists.select("l_orderkey", R.run_of_ids(F.col("ids"), F.slice("ids", 2, 2)).alias("at"))


def q_j08_trailing_specials(spark, sf_dir):
    lists = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 3).cast("int").alias("m")))), lambda x: x["m"]).alias("ids"))
    return lists.select("l_orderkey", F.array_join(R.without_trailing(F.col("ids"), F.array(F.lit(0))).cast("array<string>"), ",").alias("ids"))


def q_j07_utf8_tail(spark, sf_dir):
    """Texts cut after a number of bytes that may split a character."""
    docs = view(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    cut = F.substring(F.col("text").cast("binary"), F.lit(1), F.greatest(F.octet_length("text") - F.pmod("doc_id", F.lit(7)).cast("int"), F.lit(0)))
    return docs.select("doc_id", F.length(R.decoded_tail(cut)).alias("n"))


def q_j10_detokenised(spark, sf_dir):
    lists = view(spark, sf_dir, "step_views").dropDuplicates(["step_key"]).select("step_key", F.array(F.col("source"), F.col("first_command_preview"), F.col("model_name")).alias("parts"))
    return lists.select("step_key", R.joined_or_null(F.col("parts")).alias("text"))


def q_e06_desync(spark, sf_dir):
    k = F.col("o_orderkey")
    trials = view(spark, sf_dir, "orders").select((k % 3 != 0).alias("verified"), (k % 5 != 0).alias("consistent"), F.when(k % 7 == 0, F.array(F.lit("tool"))).otherwise(F.array().cast("array<string>")).alias("unsupported"))
    return rounded(R.desync_stats(trials))


def q_e07_grounding(spark, sf_dir):
    k = F.col("o_orderkey")
    pairs = view(spark, sf_dir, "orders").select(F.when(k % 4 != 0, k % 3 != 0).alias("label_agrees"), F.when(k % 5 != 0, (k % 100 - 50) / 100).alias("gap"))
    return rounded(R.grounding(pairs, 0.2))


def q_d08_first_forks(spark, sf_dir):
    """The first listing of each run, by ordinal."""
    return R.first_per_key(view(spark, sf_dir, "traces"), "run_id", ["ordinal"]).select("run_id", "ordinal", "outcome")


def q_s15_node_symbol(spark, sf_dir):
    logs = view(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("tests/a.py::Case::test_"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "[x-1]").otherwise("/sub")).alias("node"))
    return logs.select("p_partkey", R.node_symbol(F.col("node")).alias("symbol"))


def q_s28_language(spark, sf_dir):
    k = F.col("p_partkey")
    names = F.array_compact(F.array(F.when(k % 2 == 0, "setup.py"), F.when(k % 3 == 0, "go.mod"), F.when(k % 5 == 0, "Cargo.toml"), F.when(k % 7 == 0, "Makefile"), F.lit("README.md")))
    return view(spark, sf_dir, "part").select("p_partkey", R.language_of(names).alias("language"))


def q_s22_attempts(spark, sf_dir):
    return view(spark, sf_dir, "traces").where(F.col("task").isNotNull()).select("ordinal", R.attempt_of(F.col("task")).alias("a")).select("ordinal", "a.task", "a.attempt")


def q_s14_marked_output(spark, sf_dir):
    text = F.concat(F.lit("noise <<<"), F.col("p_name"), F.when(F.col("p_partkey") % 3 != 0, F.lit(">>> rest")).otherwise(F.lit("")))
    return view(spark, sf_dir, "part").select("p_partkey", R.between_marks(text, "<<<", ">>>").alias("inside"))


def q_s16_normalised_diff(spark, sf_dir):
    diff = F.concat(F.lit("diff --git a/x b/x\nindex 12..34\n\n+"), F.col("p_name"), F.lit("\n  \n-old\n"))
    return view(spark, sf_dir, "part").select("p_partkey", R.normalised_diff(diff).alias("diff"))


def q_s20_redacted(spark, sf_dir):
    from spanwright.functions.text import redacted, slug

    url = F.concat(F.lit("https://user:secret"), F.col("c_custkey").cast("string"), F.lit("@github.com/o/r"))
    return view(spark, sf_dir, "customer").select("c_custkey", redacted(url).alias("url"), slug(F.concat_ws(" ", "c_mktsegment", F.col("c_custkey").cast("string"), F.lit("!"))).alias("slug"))


def q_t03_date_range(spark, sf_dir):
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    return view(spark, sf_dir, "orders").where(day.between("1996-03-01", "1996-06-30")).select("o_orderkey")


def q_h02_key_union(spark, sf_dir):
    """Tasks of either model's losses and of any run without a model."""
    runs = view(spark, sf_dir, "v_runs").where(F.col("task").isNotNull())
    lost = lambda m: runs.where((F.col("model") == m) & (F.col("outcome") == "loss")).select("task")
    return lost("student-14b").union(lost("student-8b")).union(runs.where(F.col("model").isNull()).select("task")).distinct()


def q_h04_missing_tasks(spark, sf_dir):
    runs = view(spark, sf_dir, "v_runs").where(F.col("task").isNotNull())
    return runs.select("task").subtract(runs.where(F.col("outcome") == "win").select("task"))


def q_k07_epochs(spark, sf_dir):
    return R.epoch_order(view(spark, sf_dir, "v_task_caps"), "task", 3, 11)


def q_r05_mean_of_means(spark, sf_dir):
    return rounded(R.mean_of_means(view(spark, sf_dir, "lineitem"), "l_orderkey", "l_discount"))


def q_e24_ratio_summary(spark, sf_dir):
    rows = view(spark, sf_dir, "documents").where(F.length("text") > 0)
    return rounded(R.ratio_summary(rows, "doc_id", F.octet_length("text") / F.length("text"), 1.5))


def q_e29_strict_accuracy(spark, sf_dir):
    return rounded(view(spark, sf_dir, "step_views").dropDuplicates(["step_key"]).groupBy("source").agg(F.avg((F.trim(F.coalesce("observation_text", F.lit(""))) != "").cast("double")).alias("accuracy")))


_ONCE = r"t AS (SELECT *, CASE WHEN lower(trim(role, E' \t\n\r')) = 'agent' THEN 'assistant' ELSE lower(trim(role, E' \t\n\r')) END AS r FROM {v_turns} WHERE run_id IS NOT NULL AND idx IS NOT NULL)"
_GYM = """gym AS (SELECT concat('i', o_orderkey) AS instance_id, CASE o_orderkey % 5 WHEN 1 THEN 't.py::a|t.py::b' WHEN 2 THEN 't.py::a' WHEN 3 THEN 't.py::only' ELSE '' END AS fail_to_pass, CASE WHEN o_orderkey % 7 <> 0 THEN 'img' END AS image,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'p' END AS test_patch, CASE WHEN o_orderkey % 3 = 0 THEN 'cobol' ELSE 'python' END AS language FROM orders WHERE o_orderkey % 101 <> 0)"""
_IDS = "g AS (SELECT l_orderkey, list(CAST(l_partkey % 3 AS INT) ORDER BY l_linenumber, l_partkey % 3) AS ids FROM lineitem GROUP BY 1)"

QUERIES = {name: f for name, f in dict(globals()).items() if name.startswith("q_")}
SQL = {
    # the kept bytes are whole characters: those of the text that end within the cut
    "q_j07_utf8_tail": """WITH d AS (SELECT doc_id, text, greatest(octet_length(encode(text)) - doc_id % 7, 0) AS cut FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, cut, length(text) AS n, octet_length(encode(text)) AS bytes, list_transform(range(0, 8), lambda k: octet_length(encode(substr(text, greatest(length(text) - k, 0) + 1)))) AS tails FROM d)
SELECT doc_id, CAST(greatest(n - list_position(list_transform(tails, lambda t: bytes - t <= cut), true) + 1, 0) AS INT) AS n FROM w""",
    "q_e17_planted_ceiling": """WITH c AS (SELECT concat(n, 'w/', n, 'l@', p) AS config, n, CAST(p AS DOUBLE) AS p FROM (SELECT unnest([3, 6, 12]) AS n) CROSS JOIN (SELECT unnest(['1.0', '0.6', '0.3']) AS p)),
z AS (SELECT config, n, least(n - 1, CAST(round_even(n * 0.3, 0) AS INT)) AS nc, CAST(round_even(p * n, 0) AS INT) AS np FROM c),
r AS (SELECT config, CASE WHEN i < nc THEN 'win_clean' ELSE 'win_recovering' END AS kind FROM (SELECT *, unnest(range(0, n)) AS i FROM z) UNION ALL SELECT config, CASE WHEN i < np THEN 'loss_planted' ELSE concat('loss_', ['stops_to_ask', 'wrong_output_shape', 'drops_second_requirement'][CAST((i - np) % 3 AS INT) + 1]) END FROM (SELECT *, unnest(range(0, n)) AS i FROM z)),
caps AS (SELECT * FROM (VALUES (0, 'error_adaptation'), (1, 'proceeds_without_confirmation'), (2, 'follows_output_format'), (3, 'completes_all_requirements')) AS t(o, cap)),
l AS (SELECT config, kind, starts_with(kind, 'win') AS w, o, cap, CASE o WHEN 0 THEN CASE kind WHEN 'win_recovering' THEN 'PRESENT' WHEN 'loss_planted' THEN 'LACKING' ELSE 'NA' END WHEN 1 THEN CASE kind WHEN 'loss_stops_to_ask' THEN 'LACKING' ELSE 'PRESENT' END WHEN 2 THEN CASE kind WHEN 'loss_wrong_output_shape' THEN 'LACKING' ELSE 'NA' END ELSE CASE kind WHEN 'loss_drops_second_requirement' THEN 'LACKING' ELSE 'NA' END END AS label FROM r CROSS JOIN caps),
s AS (SELECT config, o, cap, count(*) FILTER (label <> 'NA' AND w) AS rw, count(*) FILTER (label <> 'NA' AND NOT w) AS rl, count(*) FILTER (label = 'LACKING' AND w) AS lw, count(*) FILTER (label = 'LACKING' AND NOT w) AS ll, count(*) FILTER (NOT w) AS losses FROM l GROUP BY 1, 2, 3),
g AS (SELECT *, ll / nullif(rl, 0) - lw / nullif(rw, 0) AS gap, coalesce(ll / nullif(rl, 0) - lw / nullif(rw, 0), 0) * (ll / losses) AS priority FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY priority DESC, o) - 1 AS rank, coalesce(gap >= 0.2 AND least(rw, rl) >= 3, false) AS fits FROM g),
f AS (SELECT config, arg_min(cap, rank) FILTER (fits) AS selected, max(rank) FILTER (o = 0) AS pr FROM k GROUP BY 1)
SELECT config, selected, coalesce(selected = 'error_adaptation', false) AS recovered, CASE WHEN selected = 'error_adaptation' THEN 'recovered' WHEN pr = 0 THEN 'top_ranked_but_below_threshold' ELSE 'outranked_by_distractor' END AS verdict FROM f""",
    "q_a35_planted_kinds": """WITH c AS (SELECT s_suppkey AS config, 2 + s_suppkey % 9 AS w, 1 + s_suppkey % 7 AS l, s_suppkey % 4 / 4 AS p FROM supplier), z AS (SELECT *, least(w - 1, CAST(round_even(w * 0.3, 0) AS INT)) AS nc, CAST(round_even(p * l, 0) AS INT) AS np FROM c),
r AS (SELECT config, CASE WHEN i < nc THEN 'win_clean' ELSE 'win_recovering' END AS kind FROM (SELECT *, unnest(range(0, w)) AS i FROM z) UNION ALL SELECT config, CASE WHEN i < np THEN 'loss_planted' ELSE concat('loss_', ['stops_to_ask', 'wrong_output_shape', 'drops_second_requirement'][CAST((i - np) % 3 AS INT) + 1]) END FROM (SELECT *, unnest(range(0, l)) AS i FROM z))
SELECT config, kind, count(*) AS n FROM r GROUP BY 1, 2""",
    "q_a05_atif_turns": f"WITH {_ONCE}, k AS (SELECT * FROM t WHERE r = 'tool' OR content IS NOT NULL OR thinking IS NOT NULL OR len(tool_calls) > 0) SELECT run_id, count(*) AS n, count(*) FILTER (r = 'tool') AS tool, CAST(count(*) - 1 AS INT) AS last_idx FROM k GROUP BY 1",
    "q_a06_subagents": "WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT s_suppkey AS src, unnest([(s_suppkey * 7) % n + 1, (s_suppkey * 3 + 5) % n + 1]) AS dst FROM supplier, n), w(root, file, depth, path) AS (SELECT s_suppkey, s_suppkey, 0, [s_suppkey] FROM supplier UNION ALL SELECT w.root, e.dst, w.depth + 1, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.file WHERE w.depth < 5 AND NOT list_contains(w.path, e.dst)) SELECT root, count(*) AS visits, count(DISTINCT file) AS files, max(depth) AS depth FROM w GROUP BY 1",
    "q_a19_gym_alias": f"WITH {_GYM} SELECT * FROM gym",
    "q_c20_importable": f"WITH {_GYM} SELECT CASE WHEN image IS NULL THEN 'no_image' WHEN fail_to_pass = '' THEN 'no_fail_to_pass' WHEN test_patch IS NULL THEN 'no_test_patch' WHEN language = 'cobol' THEN 'no_test_command' END AS reason, count(*) AS n FROM gym GROUP BY 1",
    "q_a27_scraped_series": "WITH m AS (SELECT DISTINCT ON (metric_id) * FROM vllm_metrics WHERE running IS NOT NULL AND gen_tokens_total IS NOT NULL) SELECT metric_id AS scrape, 'vllm:num_requests_running' AS series, running + 1.0 AS value FROM m UNION ALL SELECT metric_id, 'vllm:generation_tokens_total', gen_tokens_total FROM m",
    "q_a28_captures": "SELECT ['a', 'b', 'c', 'd'][CAST(l_orderkey % 4 AS INT) + 1] AS text, l_orderkey % 4 <> 3 AS complete, count(*) AS n, CASE WHEN l_orderkey % 4 <> 3 THEN 2 * count(*) END AS prompt, CASE l_orderkey % 4 WHEN 1 THEN 2 * count(*) WHEN 3 THEN NULL ELSE count(*) END AS tokens, CASE WHEN l_orderkey % 4 <> 3 THEN CAST(sum(l_partkey) AS BIGINT) END AS first_ids FROM lineitem GROUP BY l_orderkey % 4",
    "q_a26_byte_table": "SELECT p_partkey AS token_id, lower(hex(CASE WHEN p_partkey % 9 = 0 THEN concat('Ġ', replace(p_name, ' ', 'Ġ'), '日') ELSE concat(' ', p_name) END)) AS bytes FROM part",
    "q_a29_newest": "WITH r AS (SELECT task, concat(run_id, '#', lpad(CAST(ordinal AS VARCHAR), 9, '0')) AS path, row_number() OVER (PARTITION BY task ORDER BY CASE WHEN outcome IS NULL THEN 1 ELSE 0 END, started_at DESC, concat(run_id, '#', lpad(CAST(ordinal AS VARCHAR), 9, '0'))) AS k FROM traces WHERE task IS NOT NULL AND started_at IS NOT NULL) SELECT task, path FROM r WHERE k = 1",
    "q_b08_content_hash": "SELECT p_partkey, sha256(concat_ws(chr(0), p_name, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END)) AS sha FROM part",
    "q_d25_manifest_drift": "WITH a AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS h FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 8 = 0 THEN 'changed' ELSE p_brand END END AS h FROM part WHERE p_partkey % 6 <> 0) SELECT coalesce(a.path, b.path) AS path FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h",
    "q_d10_resume_antijoin": "WITH r AS (SELECT DISTINCT task, model FROM {v_runs} WHERE task IS NOT NULL AND model IS NOT NULL) SELECT t.task, m.model FROM (SELECT DISTINCT task FROM r) t CROSS JOIN (SELECT DISTINCT model FROM r) m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.task = t.task AND r.model = m.model)",
    "q_d33_cache_conflicts": 'SELECT l_suppkey, count(DISTINCT l_partkey) AS "values" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1',
    "q_d31_id_runs": f"WITH {_IDS}, h AS (SELECT l_orderkey, list_filter(range(1, len(ids) - len(ids[2:3]) + 2), lambda s: ids[s:s + len(ids[2:3]) - 1] = ids[2:3]) AS hits FROM g) SELECT l_orderkey, CASE WHEN len(hits) = 1 THEN CAST(hits[1] - 1 AS INT) END AS \"at\" FROM h",
    "q_j08_trailing_specials": f"WITH {_IDS}, h AS (SELECT l_orderkey, ids, list_max(list_filter(range(1, len(ids) + 1), lambda i: ids[i] <> 0)) AS z FROM g) SELECT l_orderkey, coalesce(array_to_string(ids[1:coalesce(z, 0)], ','), '') AS ids FROM h",
    "q_j10_detokenised": "WITH s AS (SELECT DISTINCT ON (step_key) * FROM step_views) SELECT step_key, source || first_command_preview || model_name AS text FROM s",
    "q_e06_desync": "WITH t AS (SELECT o_orderkey % 3 <> 0 AS v, o_orderkey % 5 <> 0 AS c, o_orderkey % 7 = 0 AS u FROM orders) SELECT count(*) AS n, count(*) FILTER (v) AS verified, count(*) FILTER (v AND NOT c) AS desynced, count(*) FILTER (u) AS blocked, round(count(*) FILTER (v AND NOT c) / count(*) FILTER (v), 9) AS desync_rate, round(count(*) FILTER (NOT v) / count(*), 9) AS unverified_rate FROM t",
    "q_e07_grounding": "WITH p AS (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 <> 0 END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 100 - 50) / 100 END AS g FROM orders), s AS (SELECT count(*) AS n, count(a) AS judged, avg(CAST(a AS INT)) AS agreement, coalesce(avg(abs(g)) FILTER (NOT a), 0) AS blur FROM p) SELECT n, judged, round(agreement, 9) AS agreement, round(blur, 9) AS blur, round(CASE WHEN agreement < 0.70 AND blur > 0.2 THEN blur ELSE CAST(0.2 AS DOUBLE) END, 9) AS suggested_min_gap, judged < 10 AS underpowered FROM s",
    "q_d08_first_forks": "SELECT run_id, ordinal, outcome FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS k FROM traces) WHERE k = 1",
    "q_s15_node_symbol": "SELECT p_partkey, concat('test_', p_size) AS symbol FROM part",
    "q_s28_language": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'rust' WHEN p_partkey % 3 = 0 THEN 'go' WHEN p_partkey % 2 = 0 THEN 'python' WHEN p_partkey % 7 = 0 THEN 'c_cpp' ELSE 'unknown' END AS language FROM part",
    "q_s22_attempts": "SELECT ordinal, CASE WHEN regexp_matches(task, '^.+-[0-9]+$') THEN regexp_extract(task, '^(.+)-([0-9]+)$', 1) ELSE task END AS task, TRY_CAST(regexp_extract(task, '^(.+)-([0-9]+)$', 2) AS INT) AS attempt FROM traces WHERE task IS NOT NULL",
    "q_s14_marked_output": "SELECT p_partkey, p_name AS inside FROM part",
    "q_s16_normalised_diff": "SELECT p_partkey, concat('+', p_name, chr(10), '-old') AS diff FROM part",
    "q_s20_redacted": "SELECT c_custkey, 'https://***@github.com/o/r' AS url, concat(lower(c_mktsegment), '-', c_custkey) AS slug FROM customer",
    "q_t03_date_range": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-07-01'",
    "q_h02_key_union": "SELECT DISTINCT task FROM {v_runs} WHERE task IS NOT NULL AND ((model IN ('student-14b', 'student-8b') AND outcome = 'loss') OR model IS NULL)",
    "q_h04_missing_tasks": "SELECT task FROM {v_runs} WHERE task IS NOT NULL EXCEPT SELECT task FROM {v_runs} WHERE outcome = 'win'",
    "q_k07_epochs": "SELECT task, CAST(e AS INT) AS epoch, CAST(row_number() OVER (PARTITION BY e ORDER BY md5(concat(task, ':', e, ':11')), task) - 1 AS INT) AS \"at\" FROM {v_task_caps} CROSS JOIN (SELECT unnest([0, 1, 2]) AS e)",
    "q_r05_mean_of_means": "SELECT round(avg(m), 9) AS mean, count(*) AS groups FROM (SELECT avg(l_discount) AS m FROM lineitem GROUP BY l_orderkey)",
    "q_e24_ratio_summary": "WITH r AS (SELECT doc_id, strlen(text) / length(text) AS r FROM documents WHERE length(text) > 0) SELECT round(min(r), 9) AS least, round(median(r), 9) AS median, round(max(r), 9) AS most, count(*) FILTER (r > 1.5) AS over, (SELECT doc_id FROM r ORDER BY r DESC, doc_id DESC LIMIT 1) AS argmax FROM r",
    "q_e29_strict_accuracy": "WITH s AS (SELECT DISTINCT ON (step_key) * FROM step_views) SELECT source, round(avg(CAST(trim(coalesce(observation_text, '')) <> '' AS INT)), 9) AS accuracy FROM s GROUP BY 1",
}
SQL = {name: oracle(text) for name, text in SQL.items()}
