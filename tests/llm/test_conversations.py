from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanwright.llm import conversations as C

TURNS = "turn_id bigint, run_id string, idx int, role string, thinking string, content string, tool_calls array<struct<id string, name string, args string>>, tool_call_id string, subagent_depth int, block string, letter string"
TRACES = "run_id string, ordinal int, turns string"


class Run:
    rows: list = []
    n = 0

    @classmethod
    def make(cls, run, *turns, start=0):
        out = []
        for k, (role, content, *rest) in enumerate(turns):
            calls, answers, depth, idx = (list(rest) + [None] * 4)[:4]
            cls.n += 1
            out.append((cls.n, run, start + k if idx is None else idx, role, None, content, calls and [(c, "f", "{}") for c in calls], answers, depth, "clash", "clash"))
        return out


CASES = {
    "good": (False, Run.make("good", ("system", "s"), (" User ", "q"), ("agent", None, ["c1"]), ("TOOL", "r", None, "c1"), ("assistant", "a"), start=1)),
    "two_questions": (True, Run.make("two_questions", ("user", "q"), ("user", "q2"), ("assistant", "a"))),
    "no_reply": (True, Run.make("no_reply", ("user", "q"), ("assistant", " \t\u00a0"))),
    "call_replies": (False, Run.make("call_replies", ("user", "q"), ("assistant", "", ["c"]), ("tool", "r", None, "c"))),
    "blank": (True, Run.make("blank", ("user", " "), ("assistant", None))),
    "late_start": (True, Run.make("late_start", ("user", "q"), ("assistant", "a"), start=2)),
    "gap": (True, Run.make("gap", ("user", "q"), ("assistant", "a", None, None, None, 5))),
    "shared": (True, Run.make("shared", ("user", "q"), ("assistant", "a", None, None, None, 0), ("assistant", "a", None, None, None, 1))),
    "role": (True, Run.make("role", ("user", "q"), ("assistant", "a"), ("narrator", "x"))),
    "null_role": (True, Run.make("null_role", ("user", "q"), ("assistant", "a"), (None, "x"))),
    "orphan": (True, Run.make("orphan", ("user", "q"), ("assistant", "a"), ("tool", "r", None, "c9"))),
    "tool_without_id": (True, Run.make("tool_without_id", ("user", "q"), ("assistant", "a"), ("tool", "r"))),
    "answer_before_call": (True, Run.make("answer_before_call", ("user", "q"), ("tool", "r", None, "c"), ("assistant", "a", ["c"]))),
    "open_call": (True, Run.make("open_call", ("user", "q"), ("assistant", "a", ["c"]))),
    "deep_user": (True, Run.make("deep_user", ("user", "q", None, None, 1), ("assistant", "a"))),
    "deep_reply": (True, Run.make("deep_reply", ("user", "q"), ("assistant", "a", None, None, 1))),
}


@pytest.fixture(scope="module")
def turns(spark):
    rows = [r for _, t in CASES.values() for r in t]
    rows += rows[:9]  # delivered twice
    rows += [(9_001, None, 0, "user", None, "x", None, None, 0, "c", "c")]
    return spark.createDataFrame(rows, TURNS)


def test_every_reason(spark, turns):
    traces = spark.createDataFrame([(r, 0, "clash") for r in CASES] + [("good", 1, "x"), ("unseen", 2, "x"), (None, 3, "x")], TRACES)
    found = [r.run_id for r in C.dropped_runs(traces, turns).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {r for r, (bad, _) in CASES.items() if bad} | {"unseen"}


def test_rebuilt(spark, turns):
    traces = spark.createDataFrame([(r, 0, "x") for r in CASES], TRACES)
    runs = defaultdict(list)
    for r in C.rebuilt_conversations(traces, turns).collect():
        runs[r.run_id].append(r)
    assert set(runs) == {"good", "call_replies"}
    good = sorted(runs["good"], key=lambda r: r.position)
    assert [r.role for r in good] == ["system", "user", "assistant", "tool", "assistant"]
    assert [r.position for r in good] == [0, 1, 2, 3, 4] and good[3].call_idx == good[2].idx


def test_blocks_compose(spark, monkeypatch):
    """A run cut into blocks of two turns has the same verdict as whole."""
    rows = Run.make("long", *[("user", "q"), ("assistant", "a")] * 50) + Run.make("long_bad", *[("user", "q"), ("assistant", "a")] * 20, ("user", "q"), ("user", "q"), *[("assistant", "a")] * 9)
    df = spark.createDataFrame(rows, TURNS)
    whole = {r.run_id: r.whole for r in C.run_status(df).collect()}
    monkeypatch.setattr(C, "BLOCK", 2)
    parts = {r.run_id: r.whole for r in C.run_status(df).collect()}
    assert whole == parts == {"long": True, "long_bad": False}


def test_empty(spark):
    none = spark.createDataFrame([], TURNS)
    traces = spark.createDataFrame([("a", 0, "x")], TRACES)
    assert [r.run_id for r in C.dropped_runs(traces, none).collect()] == ["a"]
    assert C.rebuilt_conversations(traces, none).count() == 0
    assert C.run_status(none).agg(F.count("*").alias("n")).first().n == 0
