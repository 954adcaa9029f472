"""Queries of the trajectory family over the turns of traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.operators import trajectory as T
from spanwright.plans.views import oracle, rounded, view


def _turns(spark, sf_dir):
    """Turns that can be ordered, each once."""
    return T.once(view(spark, sf_dir, "turns")).where(F.col("run_id").isNotNull() & F.col("idx").isNotNull())


def q_c30_action_steps(spark, sf_dir):
    return T.action_steps(_turns(spark, sf_dir)).select("run_id", "step", "idx", "call_id", "name")


def q_c29_tool_classes(spark, sf_dir):
    return T.action_steps(_turns(spark, sf_dir)).groupBy(T.tool_class(F.col("name")).alias("kind"), "name").agg(F.count("*").alias("n"))


def q_c22_messages(spark, sf_dir):
    return T.training_messages(_turns(spark, sf_dir)).select("run_id", "idx", "turn_id", "role", F.length("content").alias("n_chars"), "n_calls", "supervised")


def q_d22_reopd_prefixes(spark, sf_dir):
    return T.prefix_sizes(_turns(spark, sf_dir))


def q_d23_prefix_through_step(spark, sf_dir):
    return T.prefix_through_step(_turns(spark, sf_dir), 1)


def q_f14_merge_messages(spark, sf_dir):
    return T.merged_messages(T.training_messages(_turns(spark, sf_dir)))


def q_f05_segments(spark, sf_dir):
    return T.compaction_segments(_turns(spark, sf_dir), "the")


def q_f06_consecutive_roles(spark, sf_dir):
    return T.consecutive_users(T.training_messages(_turns(spark, sf_dir)))


def q_f15_last_user(spark, sf_dir):
    """Index of the last user turn of each run, and the assistant turns with reasoning before it, which are dropped."""
    turns = _turns(spark, sf_dir)
    last = turns.where(F.col("role") == "user").groupBy("run_id").agg(F.max("idx").alias("last_user"))
    thought = turns.where((F.col("role") == "assistant") & F.col("thinking").isNotNull()).select("run_id", "idx")
    return last.join(thought, "run_id", "left").groupBy("run_id").agg(F.first("last_user").alias("last_user"), F.count_if(F.col("idx") < F.col("last_user")).alias("dropped"))


def q_d18_orphans(spark, sf_dir):
    return T.orphan_results(_turns(spark, sf_dir))


def q_f17_condensed(spark, sf_dir):
    return T.condensed(_turns(spark, sf_dir)).select("run_id", "n_turns", F.md5("rendering").alias("md5"))


def q_f18_even_sample(spark, sf_dir):
    return T.even_sample(_turns(spark, sf_dir).select("run_id", "idx", "turn_id"), "run_id", ["idx", "turn_id"], 5)


def q_f07_per_task_cap(spark, sf_dir):
    rows = view(spark, sf_dir, "segments").dropDuplicates(["segment_id"]).select("task", "segment_id")
    return T.capped(rows, "task", ["segment_id"], 2)


def q_e30_shapes(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n_turns"), F.sum(F.greatest(F.coalesce(F.size("tool_calls"), F.lit(0)), F.lit(0))).cast("bigint").alias("n_tool_calls"))


def q_e12_segment_stats(spark, sf_dir):
    rows = view(spark, sf_dir, "segments").dropDuplicates(["segment_id"]).where(F.col("n_tokens") > 0)
    stats = rows.agg(
        F.count("*").alias("segments"), F.count_distinct("task").alias("tasks"), F.min("n_tokens").alias("least"), F.median("n_tokens").alias("median"), F.max("n_tokens").alias("most"),
        F.sum("n_tokens").alias("total"), F.sum("n_supervised").alias("supervised"),
    )
    at = F.floor(F.lit(0.9) * (F.lit(stats.first().segments) - 1)) + 1
    # the rank needs no collected array: a count of the lengths below each length finds it
    counts = rows.groupBy("n_tokens").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    upto = F.sum("n").over(Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    p90 = counts.withColumn("upto", upto).where(F.col("upto") >= at).agg(F.min("n_tokens").alias("p90"))
    return rounded(stats.crossJoin(p90).withColumn("supervised_share", F.col("supervised") / F.col("total")))


def q_c40_segment_problems(spark, sf_dir):
    rows = view(spark, sf_dir, "segments").dropDuplicates(["segment_id"])
    n, s = F.coalesce("n_tokens", F.lit(0)), F.coalesce("n_supervised", F.lit(0))
    roles = F.transform(F.coalesce("messages", F.array().cast("array<struct<role:string,content:string,tool_call_id:string>>")), lambda m: m["role"])
    twice = F.exists(F.arrays_zip(roles.alias("a"), F.slice(roles, F.lit(2), F.greatest(F.size(roles) - 1, F.lit(0))).alias("b")), lambda x: (x["a"] == "user") & (x["b"] == "user"))
    found = F.filter(F.array(F.when(n > 32448, "over compaction trigger"), F.when(n > 4096, "over max_length"), F.when(s == 0, "no supervised tokens"), F.when(twice, "two consecutive user turns")), lambda x: x.isNotNull())
    return rows.select("segment_id", F.array_join(found, ";").alias("problems"))


def q_e13_problem_hist(spark, sf_dir):
    return q_c40_segment_problems(spark, sf_dir).select(F.explode(F.split("problems", ";")).alias("problem")).where(F.col("problem") != "").groupBy("problem").agg(F.count("*").alias("n"))


def q_e34_rollouts_by_segments(spark, sf_dir):
    per = view(spark, sf_dir, "segments").dropDuplicates(["segment_id"]).groupBy("jobs_dir").agg(F.count("*").alias("segments"))
    return per.groupBy("segments").agg(F.count("*").alias("rollouts"))


def q_g10_longest_segments(spark, sf_dir):
    rows = view(spark, sf_dir, "segments").dropDuplicates(["segment_id"]).where(F.col("n_tokens").isNotNull())
    return rows.orderBy(F.desc("n_tokens"), "segment_id").limit(10).select("segment_id", "n_tokens")


def q_f19_file_state(spark, sf_dir):
    """Each event of a user as a write, edit or patch of one of three files."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "write").when(F.col("event_type") == "click", "edit").otherwise("patch")
    steps = view(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), kind.alias("kind"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("path"),
        F.col("props").alias("content"), F.lit('"k"').alias("old"), F.lit('"key"').alias("new"),
    )
    return T.file_states(steps)


def q_k02_bisection(spark, sf_dir):
    """Bisection of each run at a fork that its id decides; some probes are out of line, and some runs desynchronised."""
    steps = T.action_steps(_turns(spark, sf_dir)).groupBy("run_id").agg(F.count("*").cast("int").alias("n_steps"))
    h = F.pmod(F.conv(F.substring(F.md5("run_id"), 1, 6), 16, 10).cast("bigint"), F.lit(97))
    probes = steps.withColumn("fork", F.pmod(h, F.col("n_steps") + 2) - 1).select("run_id", F.explode(F.sequence(F.lit(-1), F.col("n_steps") - 1)).alias("t"), "fork", h.alias("h"))
    ok = F.when((F.col("h") % 11 == 0) & (F.col("t") == 1), None).otherwise((F.col("t") < F.col("fork")) != (F.substring(F.md5(F.concat_ws(":", "run_id", F.col("t").cast("string"))), 1, 1) == "0"))
    return T.bisected(probes.select("run_id", "t", ok.alias("ok")), steps)


_T = r"""t AS (SELECT * EXCLUDE (role, subagent_depth, rn), coalesce(subagent_depth, 0) AS depth, CASE WHEN lower(trim(role, E' \t\n\r')) = 'agent' THEN 'assistant' ELSE lower(trim(role, E' \t\n\r')) END AS role
  FROM {v_turns} WHERE run_id IS NOT NULL AND idx IS NOT NULL)"""
_STEPS = _T + """,
calls AS (SELECT run_id, idx, turn_id, unnest(tool_calls) AS c, generate_subscripts(tool_calls, 1) AS pos FROM t WHERE role = 'assistant' AND depth = 0 AND len(tool_calls) > 0),
steps AS (SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY idx, turn_id, pos) - 1 AS INT) AS step, idx, c.id AS call_id, c.name AS name FROM calls)"""
_MSG = _T + """,
msg AS (SELECT run_id, idx, turn_id, role, coalesce(content, CASE WHEN len(tool_calls) > 0 THEN '' END) AS content, coalesce(len(tool_calls), 0) AS n_calls FROM t WHERE depth = 0 AND NOT (role = 'system' AND coalesce(starts_with(content, '[subagent'), false)))"""
_SEG = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY n_tokens) AS rn FROM segments) WHERE rn = 1)"
_PROBLEMS = _SEG + """,
p AS (SELECT segment_id, concat_ws(';', CASE WHEN coalesce(n_tokens, 0) > 32448 THEN 'over compaction trigger' END, CASE WHEN coalesce(n_tokens, 0) > 4096 THEN 'over max_length' END, CASE WHEN coalesce(n_supervised, 0) = 0 THEN 'no supervised tokens' END,
  CASE WHEN len(list_filter(range(1, coalesce(len(messages), 0)), lambda i: messages[i].role = 'user' AND messages[i + 1].role = 'user')) > 0 THEN 'two consecutive user turns' END) AS problems FROM s)"""

def _points(largest: str, steps: str, visited: str) -> str:
    """SQL of the first two unvisited points: the middles below and above the fork, then what is left, sorted."""
    below, above = f"list_filter(range(0, coalesce({largest}, 0)), lambda x: NOT list_contains({visited}, x))", f"list_filter(range(coalesce({largest} + 2, 0), {steps}), lambda x: NOT list_contains({visited}, x))"
    middle = lambda p: f"CASE WHEN len({p}) > 0 THEN [({p})[len({p}) // 2 + 1]] ELSE [] END"
    picks = f"list_concat({middle(below)}, {middle(above)})"
    return f"list_sort(list_concat({picks}, list_filter(list_concat({below}, {above}), lambda x: NOT list_contains({picks}, x)))[1:2])"


_BISECT = _STEPS + r""",
sized AS (SELECT run_id, CAST(count(*) AS INT) AS n, CAST(concat('0x', substr(md5(run_id), 1, 6)) AS BIGINT) % 97 AS h FROM steps GROUP BY 1),
probe AS (SELECT run_id, CAST(t AS INT) AS t, CASE WHEN h % 11 = 0 AND t = 1 THEN NULL ELSE (t < h % (n + 2) - 1) <> (substr(md5(concat(run_id, ':', t)), 1, 1) = '0') END AS ok FROM (SELECT *, unnest(range(-1, n)) AS t FROM sized))"""
_SEARCH = """search(run_id, n, lo, hi, best, visited, dropped) AS (SELECT run_id, n, CAST(-1 AS INT), n - 1, CAST(NULL AS INT), CAST([] AS INT[]), false FROM sized UNION ALL
  SELECT s.run_id, s.n, CASE WHEN p.ok THEN p.t + 1 ELSE s.lo END, CASE WHEN p.ok THEN s.hi ELSE p.t - 1 END, CASE WHEN p.ok THEN p.t ELSE s.best END, list_append(s.visited, p.t), p.ok IS NULL
  FROM search s JOIN probe p ON p.run_id = s.run_id AND p.t = CAST(floor((s.lo + s.hi) / 2.0) AS INT) WHERE s.lo <= s.hi AND NOT s.dropped)"""
_BISECTED = f"""ended AS (SELECT run_id, max(n) AS n, arg_max(best, len(visited)) AS b0, max(best) AS largest, arg_max(visited, len(visited)) AS visited, bool_or(dropped) AS dropped FROM search GROUP BY 1),
pts AS (SELECT *, CASE WHEN dropped THEN [] ELSE {_points('largest', 'n', 'visited')} END AS points FROM ended),
seen AS (SELECT q.run_id, count(*) FILTER (p.ok IS NOT NULL) AS checked, count(*) FILTER (p.ok <> (p.t <= coalesce(q.largest, -2))) AS violations FROM (SELECT run_id, largest, unnest(points) AS t FROM pts) q JOIN probe p ON p.run_id = q.run_id AND p.t = q.t GROUP BY 1),
bisected AS (SELECT q.run_id, n AS n_steps, CASE WHEN NOT dropped THEN largest END AS largest, CASE WHEN NOT dropped AND NOT coalesce(largest = n - 1, false) THEN coalesce(largest + 1, 0) END AS forking_step, dropped, len(visited) <= ceil(log2(n)) + 2 AS budget_ok,
  CAST(coalesce(checked, 0) AS INT) AS checked, CAST(coalesce(violations, 0) AS INT) AS violations, coalesce(violations, 0) = 0 AS monotone FROM pts q LEFT JOIN seen s ON s.run_id = q.run_id)"""
_BISECTION = f"WITH RECURSIVE {_BISECT}, {_SEARCH}, {_BISECTED}"

QUERIES = {name: f for name, f in dict(globals()).items() if name.startswith("q_")}
SQL = {
    "q_c30_action_steps": f"WITH {_STEPS} SELECT * FROM steps",
    "q_c29_tool_classes": f"WITH {_STEPS} SELECT CASE WHEN lower(name) IN ('write_file', 'create_file', 'write', 'create') THEN 'write' WHEN lower(name) IN ('str_replace', 'str_replace_editor', 'edit_file', 'edit', 'replace') THEN 'edit' WHEN lower(name) IN ('apply_patch', 'patch') THEN 'patch' WHEN lower(name) IN ('bash', 'shell', 'run_terminal_cmd', 'execute') THEN 'exec' WHEN lower(name) IN ('read_file', 'read', 'view', 'cat', 'open', 'ls', 'list_files', 'glob', 'grep', 'search', 'find', 'think', 'todo', 'task_done') THEN 'read' ELSE 'other' END AS kind, name, count(*) AS n FROM steps GROUP BY 1, 2",
    "q_c22_messages": f"WITH {_MSG} SELECT run_id, idx, turn_id, role, CAST(length(content) AS INT) AS n_chars, CAST(n_calls AS INT) AS n_calls, role = 'assistant' AS supervised FROM msg",
    "q_d22_reopd_prefixes": f"WITH {_T}, p AS (SELECT *, count(*) OVER w AS prefix_turns, coalesce(sum(coalesce(length(content), 0)) OVER w, 0) AS prefix_chars FROM t WINDOW w AS (PARTITION BY run_id ORDER BY idx, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY idx, turn_id) - 1 AS INT) AS example, idx, prefix_turns, CAST(prefix_chars AS BIGINT) AS prefix_chars FROM p WHERE role = 'assistant' AND depth = 0",
    "q_d23_prefix_through_step": f"WITH {_STEPS}, a AS (SELECT run_id, idx AS at FROM steps WHERE step = 1), b AS (SELECT a.run_id, a.at, min(t.idx) AS stop FROM a LEFT JOIN t ON t.run_id = a.run_id AND t.role = 'assistant' AND t.depth = 0 AND t.idx > a.at GROUP BY 1, 2) SELECT t.run_id, count(*) AS n_turns, max(t.idx) AS last_idx FROM t JOIN b ON b.run_id = t.run_id WHERE b.stop IS NULL OR t.idx < b.stop GROUP BY 1",
    "q_f14_merge_messages": f"WITH {_MSG}, m AS (SELECT *, role IN ('tool', 'user') AS u, lag(role) OVER w IN ('tool', 'user') AS pu FROM msg WINDOW w AS (PARTITION BY run_id ORDER BY idx, turn_id)), i AS (SELECT *, sum(CASE WHEN u AND coalesce(pu, false) THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY idx, turn_id) - 1 AS message_no FROM m) SELECT run_id, CAST(message_no AS BIGINT) AS message_no, min(idx) AS first_idx, max(CASE WHEN u THEN 'user' ELSE role END) AS role, count(*) AS blocks, count(*) FILTER (role = 'tool') AS tool_blocks FROM i GROUP BY 1, 2",
    "q_f05_segments": f"WITH {_T}, m AS (SELECT *, role = 'system' AND coalesce(contains(content, 'the'), false) AS cut FROM t WHERE depth = 0 AND NOT (role = 'system' AND coalesce(starts_with(content, '[subagent'), false))), n AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY run_id ORDER BY idx, turn_id) AS segment FROM m) SELECT run_id, CAST(segment AS BIGINT) AS segment, count(*) AS n_turns, min(idx) AS first_idx, max(idx) AS last_idx FROM n WHERE NOT cut GROUP BY 1, 2",
    "q_f06_consecutive_roles": f"WITH {_MSG}, m AS (SELECT run_id, role = 'user' AND lag(role) OVER (PARTITION BY run_id ORDER BY idx, turn_id) = 'user' AS again FROM msg) SELECT run_id, count(*) FILTER (again) AS n FROM m GROUP BY 1 HAVING count(*) FILTER (again) > 0",
    "q_f15_last_user": f"WITH {_T}, l AS (SELECT run_id, max(idx) AS last_user FROM t WHERE role = 'user' GROUP BY 1) SELECT l.run_id, l.last_user, (SELECT count(*) FROM t WHERE t.run_id = l.run_id AND t.role = 'assistant' AND t.thinking IS NOT NULL AND t.idx < l.last_user) AS dropped FROM l",
    "q_d18_orphans": f"WITH {_T}, c AS (SELECT DISTINCT run_id, unnest(tool_calls).id AS id FROM t WHERE len(tool_calls) > 0) SELECT t.run_id, t.turn_id, t.tool_call_id FROM t LEFT JOIN c ON c.run_id = t.run_id AND c.id = t.tool_call_id WHERE t.tool_call_id IS NOT NULL AND c.id IS NULL",
    "q_f17_condensed": f"WITH {_T}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx, turn_id) AS nth, count(*) OVER (PARTITION BY run_id) AS n FROM t), l AS (SELECT run_id, nth, n, concat(CASE WHEN n > 60 AND nth = n - 29 THEN concat('... [', n - 60, ' turns omitted] ...' || chr(10)) ELSE '' END, '[', idx, '] ', role, ':', CASE WHEN content IS NULL OR content = '' THEN '' WHEN length(content) > 400 THEN concat(' ', substr(content, 1, 400), '...') ELSE concat(' ', content) END) AS line FROM n WHERE n <= 60 OR nth <= 30 OR nth > n - 30) SELECT run_id, max(n) AS n_turns, md5(string_agg(line, chr(10) ORDER BY nth)) AS md5 FROM l GROUP BY 1",
    "q_f18_even_sample": f"WITH {_T}, n AS (SELECT run_id, idx, turn_id, row_number() OVER (PARTITION BY run_id ORDER BY idx, turn_id) - 1 AS nth, count(*) OVER (PARTITION BY run_id) AS n FROM t) SELECT run_id, idx, turn_id FROM n WHERE n <= 5 OR list_contains(list_transform(range(0, 5), lambda i: i * n // 5), nth)",
    "q_f07_per_task_cap": f"WITH {_SEG} SELECT task, segment_id FROM (SELECT task, segment_id, row_number() OVER (PARTITION BY task ORDER BY segment_id) AS k FROM s) WHERE k <= 2",
    "q_k02_bisection": f"{_BISECTION} SELECT * FROM bisected",
    "q_f19_file_state": """WITH RECURSIVE s AS (SELECT user_id AS run_id, concat('f', event_id % 3) AS path, props AS content, CASE WHEN event_type IN ('view', 'signup') THEN 'write' WHEN event_type = 'click' THEN 'edit' ELSE 'patch' END AS kind, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS k FROM events),
w(run_id, path, k, content) AS (SELECT run_id, path, k, CASE WHEN kind = 'write' THEN coalesce(content, '') END FROM s WHERE k = 1 UNION ALL SELECT s.run_id, s.path, s.k, CASE s.kind WHEN 'write' THEN coalesce(s.content, '') WHEN 'edit' THEN CASE WHEN len(string_split(w.content, '"k"')) = 2 THEN replace(w.content, '"k"', '"key"') END END FROM w JOIN s ON s.run_id = w.run_id AND s.path = w.path AND s.k = w.k + 1)
SELECT run_id, path, content FROM w WHERE (run_id, path, k) IN (SELECT run_id, path, max(k) FROM s GROUP BY 1, 2)""",
    "q_e30_shapes": f"WITH {_T} SELECT run_id, count(*) AS n_turns, CAST(sum(coalesce(len(tool_calls), 0)) AS BIGINT) AS n_tool_calls FROM t GROUP BY 1",
    "q_e12_segment_stats": f"WITH {_SEG}, r AS (SELECT * FROM s WHERE n_tokens > 0) SELECT count(*) AS segments, count(DISTINCT task) AS tasks, min(n_tokens) AS least, median(n_tokens) AS median, max(n_tokens) AS most, CAST(sum(n_tokens) AS BIGINT) AS total, CAST(sum(n_supervised) AS BIGINT) AS supervised, (SELECT n_tokens FROM (SELECT n_tokens, row_number() OVER (ORDER BY n_tokens) - 1 AS k FROM r) WHERE k = floor(0.9 * ((SELECT count(*) FROM r) - 1))) AS p90, round(sum(n_supervised) / sum(n_tokens), 9) AS supervised_share FROM r",
    "q_c40_segment_problems": f"WITH {_PROBLEMS} SELECT * FROM p",
    "q_e13_problem_hist": f"WITH {_PROBLEMS} SELECT problem, count(*) AS n FROM (SELECT unnest(string_split(problems, ';')) AS problem FROM p) WHERE problem <> '' GROUP BY 1",
    "q_e34_rollouts_by_segments": f"WITH {_SEG} SELECT segments, count(*) AS rollouts FROM (SELECT jobs_dir, count(*) AS segments FROM s GROUP BY 1) GROUP BY 1",
    "q_g10_longest_segments": f"WITH {_SEG} SELECT segment_id, n_tokens FROM s WHERE n_tokens IS NOT NULL ORDER BY n_tokens DESC, segment_id LIMIT 10",
}
SQL = {name: oracle(text) for name, text in SQL.items()}
