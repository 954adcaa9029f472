"""Completions by their grammar, bisection with verification, folds and streamed hashes against plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spanwright.operators import align as A
from spanwright.operators import checks as C
from spanwright.operators import records as R
from spanwright.operators import trajectory as T

CALL = f'<{C.DSML}invoke name="f">\n<{C.DSML}parameter name="a" string="true">x "y"\n</{C.DSML}parameter>\n<{C.DSML}parameter name="b" string="false">[1, 2]</{C.DSML}parameter>\n</{C.DSML}invoke>\n'
BLOCK = f"{C.CALLS}>\n{CALL}{C.CALLS_END}"


def parsed(spark, text, **options):
    return spark.createDataFrame([(text,)], "t string").select(C.parsed_completion(F.col("t"), **options).alias("c")).first().c


def test_a_sound_completion(spark):
    c = parsed(spark, f"so\n{C.THINK_END}done{BLOCK}{C.EOS}")
    assert (c.reasoning, c.content, c.error) == ("so\n", "done", None)
    assert [(x.name, json.loads(x.arguments)) for x in c.calls] == [("f", {"a": 'x "y"\n', "b": [1, 2]})]
    assert parsed(spark, f"a{C.EOS}", thinking=False).content == "a"
    assert parsed(spark, f"{C.THINK_END}{C.CALLS}>\n{C.CALLS_END}").calls == []
    assert parsed(spark, None) is None


@pytest.mark.parametrize("text,error", [
    (f"no mark{C.EOS}", "thinking"),
    (f"{C.CALLS}{C.THINK_END}{C.EOS}", "thinking"),
    (f"x{C.THINK_END}no end", "end"),
    (f"x{C.THINK_END}a{C.EOS}more", "end"),
    (f"x{C.THINK_END}a{BLOCK}more{C.EOS}", "tool_calls"),
    (f"x{C.THINK_END}a{BLOCK.replace('name=', 'nam=', 1)}{C.EOS}", "tool_calls"),
    (f"x{C.THINK_END}a{BLOCK.replace('>' + chr(10) + '<', '><', 1)}{C.EOS}", "tool_calls"),
    (f"x{C.THINK_END}a{BLOCK.replace('string=' + chr(34) + 'false', 'string=' + chr(34) + 'no')}{C.EOS}", "tool_calls"),
    (f"x{C.THINK_END}a{BLOCK.replace('name=' + chr(34) + 'b', 'name=' + chr(34) + 'a')}{C.EOS}", "duplicate_parameter"),
    (f"x{C.THINK}{C.THINK_END}a{C.EOS}", "special_token"),
])
def test_malformed_completions(spark, text, error):
    c = parsed(spark, text)
    assert (c.error, c.content, c.calls) == (error, None, None)
    with pytest.raises(Exception, match="malformed completion"):
        parsed(spark, text, strict=True)


def test_bisection_verifies(spark):
    runs = {"steady": (8, lambda t: t < 3), "never": (8, lambda t: False), "always": (8, lambda t: True), "odd": (16, lambda t: t < 5 or t == 11), "lost": (8, lambda t: None), "none": (0, lambda t: True)}
    probes = spark.createDataFrame([(r, t, ok(t)) for r, (n, ok) in runs.items() for t in range(-1, n)], "run_id string, t int, ok boolean")
    steps = spark.createDataFrame([(r, n) for r, (n, _) in runs.items()], "run_id string, n_steps int")
    found = {r.run_id: r for r in T.bisected(probes, steps, verify=20).collect()}
    assert (found["steady"].forking_step, found["steady"].monotone, found["steady"].violations) == (3, True, 0)
    assert (found["never"].forking_step, found["always"].forking_step, found["always"].largest) == (0, None, 7)
    assert (found["odd"].monotone, found["odd"].violations) == (False, 1)
    assert found["lost"].dropped and found["lost"].forking_step is None and found["lost"].checked == 0
    assert found["none"].forking_step is None and found["none"].budget_ok


def test_epochs_are_in_hash_order(spark):
    rows = spark.createDataFrame([(f"t{i}",) for i in range(500)], "task string")
    found = {}
    for r in R.epoch_order(rows, "task", 2, 5).collect():
        found[r.epoch, r["at"]] = r.task
    for e in range(2):
        assert [found[e, k] for k in range(500)] == sorted((f"t{i}" for i in range(500)), key=lambda t: (hashlib.md5(f"{t}:{e}:5".encode()).hexdigest(), t))


def test_fingerprints(spark):
    rows = [("a", i, bytes([i % 7, i])) for i in range(200)] + [("b", 3, b"x")]
    df = spark.createDataFrame(rows, "side string, id long, b binary").repartition(5)
    expected = {s: hashlib.sha256("\n".join(f"{i}:{b.hex()}" for x, i, b in sorted(rows, key=lambda r: r[1]) if x == s).encode()).hexdigest() for s in "ab"}
    assert {r.side: r.sha256 for r in A.fingerprint(df, "id", F.col("b"), "side").collect()} == expected


def test_folds_over_turns(spark):
    df = spark.createDataFrame([([3, 0, 5], [True, False, True], [9, 1, 1]), ([], [], [])], "n array<int>, s array<boolean>, m array<int>")
    first, none = df.select(C.label_spans(F.col("n"), F.col("s")).alias("x"), C.dropped_turns(F.col("n"), F.col("m"), 5).alias("d")).collect()
    assert [(x.start, x.end) for x in first.x] == [(0, 3), (3, 8)] and first.d == 1
    assert none.x == [] and none.d == 0
