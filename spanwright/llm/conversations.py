"""Rebuilding conversations from message rows, and finding those that are broken.

Rows are partitioned by conversation and block of the sequence number and sorted by it. A
finite-state automaton reads the turns of a block from each of its entry states, which gives the
block's transition map; the maps of a conversation's blocks compose in order. So a conversation
holding a third of all rows is read in many tasks and ends as one short row per block. The automaton
decides on sequence numbers, roles, questions and replies: an unknown role, a missing or shared number
or a gap is a letter that breaks it, and only a run that ends with its last question answered is accepted,
which an empty or blank one never is.

The ties of calls to results have no finite alphabet, so an automaton of its own reads each (conversation,
call id): a result before any call breaks it, a call opens it, a later result closes it. The state in which
it ends depends on the first and last call and result only, which are combined before the exchange. Turns
and ties come from one scan and share one exchange.

Defined results: a repeated delivery of a turn counts once; roles are trimmed, lower-cased, and
``agent`` is ``assistant``; a null depth is 0; a turn with a null run takes no part, one with a null
sequence number breaks its run; a null call id or a tool turn without one ties to nothing; an empty
table of turns makes every listed run broken; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.runtime import materialize

ROLES = ("system", "user", "assistant", "tool")
BLOCK = 4096  # sequence numbers a block
# states of the automaton: no question yet, the last one answered, the last one open, broken
NONE, ANSWERED, WAITING, BROKEN = range(4)
# what a turn is to the automaton
OTHER, ASKS, REPLIES, BREAKS = range(4)
_SPACE = r"(?U)[\s\x1c-\x1f]"


def clean_role(role: Column) -> Column:
    bare = F.lower(F.regexp_replace(role, rf"^{_SPACE}+|{_SPACE}+$", ""))
    return F.when(bare == "agent", "assistant").otherwise(bare)


def blank(content: Column, tool_calls: Column) -> Column:
    """A turn that makes no call and whose content is null or white space."""
    no_text = content.isNull() | ~content.rlike(r"(?U)[^\s\x1c-\x1f]")
    return no_text & (F.coalesce(F.size(tool_calls), F.lit(0)) <= 0)


def _letter() -> Column:
    """What a turn is to the automaton, were it in its place."""
    role = clean_role(F.col("role"))
    depth0 = F.coalesce(F.col("subagent_depth"), F.lit(0)) == 0
    known = F.coalesce(role.isin(*ROLES), F.lit(False)) & F.col("idx").isNotNull()
    empty = blank(F.col("content"), F.col("tool_calls"))
    return F.when(~known, BREAKS).when(depth0 & (role == "user"), ASKS).when(depth0 & (role == "assistant") & ~empty, REPLIES).otherwise(OTHER).cast("tinyint")


def _after(state: Column, letter: Column) -> Column:
    """The transition function: a second question breaks an open one, a reply answers it."""
    asks = F.when(state == WAITING, BROKEN).otherwise(WAITING)
    replies = F.when(state == NONE, NONE).otherwise(ANSWERED)
    return F.when((state == BROKEN) | (letter == BREAKS), BROKEN).when(letter == ASKS, asks).when(letter == REPLIES, replies).otherwise(state).cast("tinyint")


def _transition_map(turns: Column) -> Column:
    """Where a block's ordered turns lead from each entry state; a turn that doesn't follow its predecessor breaks the run."""

    def step(held: Column, turn: Column) -> Column:
        letter = F.when(turn["idx"] == held["last"] + 1, turn["letter"]).when(held["last"].isNull(), turn["letter"]).otherwise(F.lit(BREAKS))
        return F.struct(*(_after(held[n], letter).alias(n) for n in ("none", "answered", "waiting")), turn["idx"].alias("last"))

    state = lambda s, n: F.lit(s).cast("tinyint").alias(n)
    return F.aggregate(turns, F.struct(state(NONE, "none"), state(ANSWERED, "answered"), state(WAITING, "waiting"), F.lit(None).cast("bigint").alias("last")), step)


def run_status(turns: DataFrame) -> DataFrame:
    """One row per run of ``turns``: (run_id, whole BOOLEAN, n_turns)."""
    idx = F.col("idx").cast("bigint")
    block = F.coalesce(F.floor(idx / BLOCK), F.lit(-1)).cast("bigint")
    none = F.lit(None).cast("bigint")
    fact = lambda kind, block, call, turn, call_at, tool_at: F.struct(
        F.lit(kind).alias("kind"), block.alias("block"), call.alias("call"), turn.alias("turn"), call_at.alias("call_at"), tool_at.alias("tool_at")
    )
    turn = F.struct(F.col("idx"), F.col("turn_id"), F.col("letter"))
    no_turn = F.lit(None).cast("struct<idx: bigint, turn_id: bigint, letter: tinyint>")
    read = turns.where(F.col("run_id").isNotNull()).select(
        "run_id", idx.alias("idx"), F.col("turn_id").cast("bigint").alias("turn_id"), _letter().alias("letter"), block.alias("block"), (clean_role(F.col("role")) == "tool").alias("is_tool"),
        F.col("tool_call_id"), F.when(F.size("tool_calls") > 0, F.transform("tool_calls", lambda c: c["id"])).alias("calls"),
    )
    facts = F.concat(
        F.array(fact(0, F.col("block"), F.lit(None).cast("string"), turn, none, none)),
        F.coalesce(F.transform("calls", lambda c: fact(1, none, c, no_turn, F.col("idx"), none)), F.array()),
        F.when(F.col("is_tool"), F.array(fact(1, none, F.col("tool_call_id"), no_turn, none, F.col("idx")))).otherwise(F.array()),
    )
    flat = read.select("run_id", F.explode(facts).alias("f")).select("run_id", "f.*")
    # a set leaves one of a turn's deliveries
    grouped = flat.groupBy("run_id", "kind", "block", "call").agg(
        F.array_sort(F.collect_set("turn")).alias("turns"),
        F.min("call_at").alias("first_call"), F.max("call_at").alias("last_call"), F.min("tool_at").alias("first_tool"), F.max("tool_at").alias("last_tool"),
    )
    closed = (
        F.col("call").isNotNull()
        & F.when(F.col("first_tool").isNotNull(), F.coalesce(F.col("first_call") < F.col("first_tool"), F.lit(False))).otherwise(True)
        & F.when(F.col("last_call").isNotNull(), F.coalesce(F.col("last_tool") > F.col("last_call"), F.lit(False))).otherwise(True)
    )
    mapped = grouped.select(
        "run_id", F.when(F.col("kind") == 1, closed).alias("tied"), F.size("turns").alias("n"),
        F.when(F.col("kind") == 0, F.struct("block", F.element_at("turns", 1)["idx"].alias("low"), _transition_map(F.col("turns")).alias("map"))).alias("b"),
    )

    def through(held: Column, b: Column) -> Column:
        follows = F.when(held["last"].isNull(), b["low"] <= 1).otherwise(b["low"] == held["last"] + 1)
        led = F.when(held["state"] == WAITING, b["map"]["waiting"]).when(held["state"] == ANSWERED, b["map"]["answered"]).when(held["state"] == NONE, b["map"]["none"]).otherwise(F.lit(BROKEN).cast("tinyint"))
        return F.struct(F.when(F.coalesce(follows, F.lit(False)), led).otherwise(F.lit(BROKEN).cast("tinyint")).alias("state"), b["map"]["last"].alias("last"))

    start = F.struct(F.lit(NONE).cast("tinyint").alias("state"), none.alias("last"))
    runs = mapped.groupBy("run_id").agg(
        F.sum(F.when(F.col("b").isNotNull(), F.col("n")).otherwise(0)).alias("n_turns"), F.bool_and("tied").alias("tied"),
        F.aggregate(F.array_sort(F.collect_list("b")), start, through)["state"].alias("state"),
    )
    return runs.select("run_id", ((F.col("state") == ANSWERED) & F.coalesce("tied", F.lit(True))).alias("whole"), "n_turns")


def dropped_runs(traces: DataFrame, turns: DataFrame) -> DataFrame:
    """The runs listed in ``traces`` that are broken, empty or lack a reply, each once: (run_id)."""
    listed = traces.where(F.col("run_id").isNotNull()).select("run_id").distinct()
    return listed.join(run_status(turns).where("whole"), "run_id", "left_anti")


def rebuilt_conversations(traces: DataFrame, turns: DataFrame) -> DataFrame:
    """The turns of every kept run in order.

    One row per turn: (run_id, position, idx, role, depth, thinking, content, n_calls, tool_call_id,
    call_idx). ``position`` counts from 0, ``call_idx`` is the turn whose call a tool turn answers
    (the last earlier one of that id).
    """
    listed = traces.where(F.col("run_id").isNotNull()).select("run_id").distinct()
    kept = materialize(listed.join(run_status(turns).where("whole").select("run_id"), "run_id", "left_semi"), "kept")
    # where each turn stands is found on narrow columns; the texts are exchanged once, by turn
    facts = materialize(
        turns.select(
            "run_id",
            F.col("turn_id").cast("bigint").alias("turn_id"),
            F.col("idx").cast("bigint").alias("idx"),
            (clean_role(F.col("role")) == "tool").alias("is_tool"),
            "tool_call_id",
            F.when(F.size("tool_calls") > 0, F.transform("tool_calls", lambda c: c["id"])).alias("calls"),
        )
        .join(kept, "run_id", "left_semi")
        .dropDuplicates(["run_id", "turn_id"]),
        "facts",
    )
    # idx has no gap in a kept run, so the position needs no window over the run
    low = facts.groupBy("run_id").agg(F.min("idx").alias("low"))
    calls = facts.where(F.col("calls").isNotNull()).select("run_id", F.explode("calls").alias("tool_call_id"), F.col("idx").alias("made_at"))
    answers = facts.where("is_tool").select("run_id", "tool_call_id", "turn_id", "idx")
    earlier = answers.join(calls, ["run_id", "tool_call_id"]).where(F.col("made_at") < F.col("idx")).groupBy("run_id", "turn_id").agg(F.max("made_at").alias("call_idx"))
    placed = facts.select("run_id", "turn_id", "idx").join(low, "run_id").join(earlier, ["run_id", "turn_id"], "left").select("run_id", "turn_id", (F.col("idx") - F.col("low")).alias("position"), "call_idx")
    texts = turns.select(
        "run_id",
        F.col("turn_id").cast("bigint").alias("turn_id"),
        F.col("idx").cast("bigint").alias("idx"),
        clean_role(F.col("role")).alias("role"),
        F.coalesce("subagent_depth", F.lit(0)).alias("depth"),
        "thinking",
        "content",
        F.greatest(F.coalesce(F.size("tool_calls"), F.lit(0)), F.lit(0)).alias("n_calls"),
        "tool_call_id",
    ).dropDuplicates(["run_id", "turn_id"])
    return texts.join(placed, ["run_id", "turn_id"]).select("run_id", "position", "idx", "role", "depth", "thinking", "content", "n_calls", "tool_call_id", "call_idx")
