"""Agent trajectories: action steps, segments, prefixes, renderings, file state, bisection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.operators.checks import verification_points

#: Names of tools by what they do to the workspace, in lower case.
WRITE_TOOLS = ("write_file", "create_file", "write", "create")
EXEC_TOOLS = ("bash", "shell", "run_terminal_cmd", "execute")
EDIT_TOOLS = ("str_replace", "str_replace_editor", "edit_file", "edit", "replace")
PATCH_TOOLS = ("apply_patch", "patch")
READONLY_TOOLS = ("read_file", "read", "view", "cat", "open", "ls", "list_files", "glob", "grep", "search", "find", "think", "todo", "task_done")


def once(turns: DataFrame) -> DataFrame:
    """Turns without repeated deliveries, with clean roles and depths."""
    role = F.lower(F.regexp_replace("role", r"(?U)^\s+|\s+$", ""))
    return turns.dropDuplicates(["turn_id"]).withColumns({"role": F.when(role == "agent", "assistant").otherwise(role), "subagent_depth": F.coalesce("subagent_depth", F.lit(0))})


def tool_class(name: Column) -> Column:
    """write, edit, patch, exec, read or other."""
    low = F.lower(name)
    kinds = (("write", WRITE_TOOLS), ("edit", EDIT_TOOLS), ("patch", PATCH_TOOLS), ("exec", EXEC_TOOLS), ("read", READONLY_TOOLS))
    return F.coalesce(*(F.when(low.isin(*names), k) for k, names in kinds), F.lit("other"))


def action_steps(turns: DataFrame) -> DataFrame:
    """The parent agent's tool calls in order: (run_id, step, idx, call_id, name, args)."""
    calls = turns.where((F.col("role") == "assistant") & (F.col("subagent_depth") == 0)).select("run_id", "turn_id", "idx", F.posexplode("tool_calls").alias("pos", "call"))
    order = Window.partitionBy("run_id").orderBy("idx", "turn_id", "pos")
    return calls.select("run_id", (F.row_number().over(order) - 1).alias("step"), "idx", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.args").alias("args"))


def training_messages(turns: DataFrame) -> DataFrame:
    """Messages for training: no subagents and no markers of them, no thinking; a mere call has empty content."""
    kept = turns.where((F.col("subagent_depth") == 0) & ~((F.col("role") == "system") & F.coalesce(F.col("content").startswith("[subagent"), F.lit(False))))
    content = F.coalesce(F.col("content"), F.when(F.size("tool_calls") > 0, ""))
    return kept.select("run_id", "idx", "turn_id", "role", content.alias("content"), F.greatest(F.coalesce(F.size("tool_calls"), F.lit(0)), F.lit(0)).alias("n_calls"), (F.col("role") == "assistant").alias("supervised"))


def prefix_sizes(turns: DataFrame) -> DataFrame:
    """One training example per parent assistant turn: turns and characters of the prefix before it."""
    order = Window.partitionBy("run_id").orderBy("idx", "turn_id").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.coalesce(F.length("content"), F.lit(0))
    with_prefix = turns.withColumns({"prefix_turns": F.count("*").over(order), "prefix_chars": F.coalesce(F.sum(chars).over(order), F.lit(0))})
    mine = with_prefix.where((F.col("role") == "assistant") & (F.col("subagent_depth") == 0))
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("idx", "turn_id")) - 1
    return mine.select("run_id", nth.alias("example"), "idx", "prefix_turns", "prefix_chars")


def prefix_through_step(turns: DataFrame, last_step: int) -> DataFrame:
    """Per run the turns up to, but not including, the next parent assistant turn after an action step."""
    at = action_steps(turns).where(F.col("step") == last_step).select("run_id", F.col("idx").alias("action_idx"))
    assistants = turns.where((F.col("role") == "assistant") & (F.col("subagent_depth") == 0)).select("run_id", F.col("idx").alias("next_idx"))
    following = at.join(assistants, "run_id").where(F.col("next_idx") > F.col("action_idx")).groupBy("run_id").agg(F.min("next_idx").alias("stop"))
    bounded = at.join(following, "run_id", "left")
    return turns.join(bounded, "run_id").where(F.col("stop").isNull() | (F.col("idx") < F.col("stop"))).groupBy("run_id").agg(F.count("*").alias("n_turns"), F.max("idx").alias("last_idx"))


def merged_messages(messages: DataFrame) -> DataFrame:
    """Neighbouring tool and user messages become one user message of several blocks."""
    order = Window.partitionBy("run_id").orderBy("idx", "turn_id")
    user = F.col("role").isin("tool", "user")
    starts = ~user | ~F.coalesce(F.lag(user).over(order), F.lit(False))
    island = F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("message_no", island - 1).groupBy("run_id", "message_no").agg(
        F.min("idx").alias("first_idx"), F.max(F.when(user, "user").otherwise(F.col("role"))).alias("role"), F.count("*").alias("blocks"), F.count_if(F.col("role") == "tool").alias("tool_blocks")
    )


def compaction_segments(turns: DataFrame, boundary: str) -> DataFrame:
    """Turns of depth 0 numbered by segment: a system turn that holds ``boundary`` starts the next; empty segments drop out."""
    main = turns.where((F.col("subagent_depth") == 0) & ~((F.col("role") == "system") & F.coalesce(F.col("content").startswith("[subagent"), F.lit(False))))
    cut = (F.col("role") == "system") & F.coalesce(F.col("content").contains(boundary), F.lit(False))
    order = Window.partitionBy("run_id").orderBy("idx", "turn_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = main.withColumns({"is_cut": cut, "segment": F.sum(cut.cast("int")).over(order)})
    return numbered.where(~F.col("is_cut")).groupBy("run_id", "segment").agg(F.count("*").alias("n_turns"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def consecutive_users(messages: DataFrame) -> DataFrame:
    """Runs in which two user messages follow each other directly."""
    order = Window.partitionBy("run_id").orderBy("idx", "turn_id")
    again = (F.col("role") == "user") & (F.lag("role").over(order) == "user")
    return messages.withColumn("again", again).groupBy("run_id").agg(F.count_if("again").alias("n")).where("n > 0")


def orphan_results(turns: DataFrame) -> DataFrame:
    """Tool results whose call is made nowhere in their run."""
    calls = turns.where(F.size("tool_calls") > 0).select("run_id", F.explode("tool_calls.id").alias("tool_call_id")).distinct()
    return turns.where(F.col("tool_call_id").isNotNull()).select("run_id", "turn_id", "tool_call_id").join(calls, ["run_id", "tool_call_id"], "left_anti")


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def condensed(turns: DataFrame, max_turns: int = 60, max_chars: int = 400) -> DataFrame:
    """A short rendering of each run: its first and last turns, fields cut, and how many turns lie between."""
    order = Window.partitionBy("run_id").orderBy("idx", "turn_id")
    counted = turns.withColumns({"at": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("run_id"))})
    half = max_turns // 2
    kept = counted.where((F.col("n") <= max_turns) | (F.col("at") <= half) | (F.col("at") > F.col("n") - half))
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.coalesce("role", F.lit("")), F.lit(":"), F.coalesce(F.concat(F.lit(" "), shortened(F.nullif("content", F.lit("")), max_chars)), F.lit("")))
    first_after = (F.col("n") > max_turns) & (F.col("at") == F.col("n") - half + 1)
    text = F.when(first_after, F.concat(F.lit("... ["), (F.col("n") - max_turns).cast("string"), F.lit(" turns omitted] ...\n"), line)).otherwise(line)
    return kept.groupBy("run_id").agg(F.max("n").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("text")))), lambda x: x["text"]), "\n").alias("rendering"))


def even_sample(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """``size`` rows of each key at the indices ``floor(i * n / size)``; all where there are no more."""
    by = Window.partitionBy(key)
    ranked = rows.withColumns({"at": F.row_number().over(by.orderBy(*order)) - 1, "n": F.count("*").over(by)})
    # an index is taken when some i < size has floor(i * n / size) equal to it
    i = F.ceil(F.col("at") * size / F.col("n"))
    taken = (F.col("n") <= size) | ((i < size) & (F.floor(i * F.col("n") / size) == F.col("at")))
    return ranked.where(taken).drop("at", "n")


def capped(rows: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("at") <= limit).drop("at")


def file_states(steps: DataFrame) -> DataFrame:
    """What each run's calls make of the files: (run_id, path, content); null where it can't be told.

    ``steps`` is (run_id, step, kind, path, content, old, new). A written file is known, an edit
    keeps it known only if the old text occurs once, a patch leaves it unknown.
    """
    ordered = F.array_sort(F.collect_list(F.struct("step", "kind", "content", "old", "new")))
    unknown = F.lit(None).cast("string")

    def step(state: Column, s: Column) -> Column:
        matches = F.when(F.length(s["old"]) > 0, F.size(F.split(state, F.concat(F.lit(r"\Q"), s["old"], F.lit(r"\E")), -1)) - 1).otherwise(0)
        edited = F.when(matches == 1, F.replace(state, s["old"], F.coalesce(s["new"], F.lit(""))))
        return F.when(s["kind"] == "write", F.coalesce(s["content"], F.lit(""))).when(s["kind"] == "edit", edited).otherwise(unknown)

    # files of a run don't touch each other, so each path folds by itself
    return steps.groupBy("run_id", "path").agg(F.aggregate(ordered, unknown, step).alias("content"))


def bisected(probes: DataFrame, steps: DataFrame, verify: int = 2) -> DataFrame:
    """Where each run stopped being recoverable, by binary search over recorded probes, and whether more probes agree.

    ``probes`` is (run_id, t, ok) with ``ok`` true if any sample succeeded and null for a desynchronised one, which
    drops the run; ``steps`` is (run_id, n_steps). A run's probes meet in one row and are searched by a fold that
    halves its range at each turn. ``verify`` probes that the search never visited then test that recoverability only
    ever falls: ``violations`` of the ``checked`` ones contradict the fork.
    """
    code = F.when(F.col("ok").isNull(), 2).otherwise(F.col("ok").cast("int"))
    recorded = probes.groupBy("run_id", F.col("t").cast("int").alias("t")).agg(F.max(code).alias("code")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "code"))).alias("at"))
    runs = steps.select("run_id", F.col("n_steps").cast("int").alias("n_steps")).join(recorded, "run_id", "left")
    empty = F.array().cast("array<int>")
    begin = F.struct(F.lit(-1).alias("lo"), (F.col("n_steps") - 1).alias("hi"), F.lit(None).cast("int").alias("best"), empty.alias("visited"), F.lit(False).alias("dropped"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        code = F.try_element_at("at", mid)
        on = (s["lo"] <= s["hi"]) & ~s["dropped"] & (F.col("n_steps") > 0) & code.isNotNull()
        when = lambda cond, a, b: F.when(on & cond, a).otherwise(b)
        return F.struct(
            when(code == 1, mid + 1, s["lo"]).alias("lo"), when(code != 1, mid - 1, s["hi"]).alias("hi"), when(code == 1, mid, s["best"]).alias("best"),
            F.when(on, F.array_append(s["visited"], mid)).otherwise(s["visited"]).alias("visited"), (s["dropped"] | F.coalesce(on & (code == 2), F.lit(False))).alias("dropped"),
        )

    searched = runs.select("run_id", "n_steps", "at", F.explode(F.array(F.aggregate(F.sequence(F.lit(1), F.lit(32)), begin, halve))).alias("s"))
    found = searched.select("run_id", "n_steps", "at", F.col("s.best").alias("largest"), "s.dropped", "s.visited")
    points = F.when(~F.col("dropped") & (F.col("n_steps") > 0), verification_points(F.col("largest"), F.col("n_steps"), F.col("visited"), verify)).otherwise(empty)
    checks = F.filter(F.transform(points, lambda t: F.struct((t <= F.coalesce("largest", F.lit(-2))).alias("expected"), F.try_element_at("at", t).alias("code"))), lambda c: c["code"].isin(0, 1))
    read = found.select("*", F.explode(F.array(checks)).alias("checks"))
    whole = F.col("largest") == F.col("n_steps") - 1
    fork = F.when(~F.col("dropped") & (F.col("n_steps") > 0) & ~F.coalesce(whole, F.lit(False)), F.coalesce(F.col("largest") + 1, F.lit(0)))
    budget = F.when(F.col("n_steps") > 0, F.ceil(F.log2("n_steps")) + 2)
    violations = F.size(F.filter("checks", lambda c: c["expected"] != (c["code"] == 1)))
    return read.select(
        "run_id", "n_steps", F.when(~F.col("dropped"), F.col("largest")).alias("largest"), fork.alias("forking_step"), "dropped", F.coalesce(F.size("visited") <= budget, F.lit(True)).alias("budget_ok"),
        F.size("checks").alias("checked"), violations.alias("violations"), (violations == 0).alias("monotone"),
    )
