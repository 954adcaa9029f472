import json

import pytest
from pyspark.sql import functions as F

from spanwright.functions import sql as sqlfuncs
from spanwright.functions import text as X
from spanwright.sources import files, recorded, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("traces")
    turns = [{"index": 0, "role": "user", "content": "q"}, {"index": 1, "role": "assistant", "toolCalls": None, "subagentDepth": 2}]
    (d / "t").mkdir()
    (d / "t" / "one.json").write_text(json.dumps({"runId": "r1", "status": "success", "turns": turns}, indent=1))
    (d / "t" / "two.json").write_text(json.dumps({"status": "unknown", "turns": []}))
    (d / "t" / "three.json").write_text(json.dumps({"runId": "r3", "status": "failure", "turns": turns}))
    (d / "manifest.json").write_text(json.dumps([{"path": "t/one.json", "task": "a"}, {"path": "t/two.json"}, {"path": "t/three.json", "outcome": "win", "model": "m"}], indent=1))
    return d


def test_manifest_and_traces(spark, folder):
    rows = files.manifest_traces(spark, f"{folder}/manifest.json").orderBy("ordinal").collect()
    assert [(r.run_id, r.outcome, r.task, r.model) for r in rows] == [("r1", "win", "a", None), ("two", "loss", None, None), ("r3", "win", None, "m")]
    turns = files.exploded_turns(files.traces(spark, [f"{folder}/t"])).where("run_id = 'r1'").orderBy("idx").collect()
    assert [(t.idx, t.role, t.subagent_depth, t.tool_calls) for t in turns] == [(0, "user", 0, []), (1, "assistant", 2, [])]


def test_three_ways_with_a_bad_line(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2\n{"a": 3}\n')
    assert [r.a for r in files.json_lines(spark, str(p), "a int").collect()] == [1, 3]
    kept = files.json_lines(spark, str(p), "a int", "keep").collect()
    assert [(r.a, r._bad) for r in kept] == [(1, None), (None, '{"a": 2'), (3, None)]
    with pytest.raises(Exception):
        files.json_lines(spark, str(p), "a int", "fail").collect()


def test_git_log(spark, tmp_path):
    p = tmp_path / "log.txt"
    sep, end = "\x1f", "\x1e"
    p.write_text(f"s1{sep}p1 p2{sep}An{sep}a@x{sep}2024{sep}sub{sep}body\nmore{end}\nshort{sep}x{end}\ns2{sep}{sep}Bo{sep}b@x{sep}2023{sep}sub2{sep}{end}")
    rows = files.git_log(spark, str(p)).orderBy("sha").collect()
    assert [(r.sha, r.parents, r.subject, r.body) for r in rows] == [("s1", ["p1", "p2"], "sub", "body\nmore"), ("s2", [], "sub2", "")]


def test_messages_of_parts(spark):
    parts = json.dumps([{"type": "text", "text": "a"}, {"type": "image_url"}, {"type": "text", "text": "b"}])
    assert value(spark, files.flat_message(F.lit(parts))) == "a\n[image]\nb"
    assert value(spark, files.flat_message(F.lit("plain"))) == "plain"


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")], "src string, dst string")
    rows = files.reachable_files(spark.createDataFrame([("a",)], "root string"), edges).collect()
    assert sorted((r.file, r.depth) for r in rows) == [("a", 0), ("b", 1), ("c", 2)]


def test_scrape(spark):
    text = ["# TYPE x", 'vllm:num_requests_running{m="a"} 2', 'vllm:num_requests_running{m="b"} 3.5', "vllm:gpu_cache_usage_perc 1e-1", "other 4", "junk"]
    rows = files.scraped_series(spark.createDataFrame([(1, t) for t in text], "scrape int, value string")).collect()
    assert {r.series: r.value for r in rows} == {"vllm:num_requests_running": 5.5, "vllm:gpu_cache_usage_perc": 0.1}


def test_byte_table(spark):
    rows = files.byte_table(spark.createDataFrame([(1, "Ġhi"), (2, "Ã©"), (3, "日")], "token_id int, token string")).collect()
    assert {r.token_id: bytes(r.bytes) for r in rows} == {1: b" hi", 2: "é".encode(), 3: "日".encode()}


def test_recorded_pull_requests(spark, tmp_path):
    rows = [{"number": 1, "merged_at": "2024-02-01T00:00:00Z", "base_sha": "b"}, {"number": 2, "merged_at": "2024-02-02", "base_sha": "b", "is_draft": True}, {"number": 3, "merged_at": "2024-03-01", "base_sha": None}, {"number": 4, "merged_at": "2025-01-01", "base_sha": "b"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    recorded.register(spark)
    found = spark.read.format("recorded_prs").option("path", str(tmp_path)).option("until", "2024-12-31").load().collect()
    assert [r.number for r in found] == [1]


def test_append_missing_resumes(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert sinks.append_missing(df, path, ["k"]) == 2
    assert sinks.append_missing(df.union(spark.createDataFrame([(3, "c")], "k int, v string")), path, ["k"]) == 1
    assert spark.read.parquet(path).count() == 3
    sinks.write_report(df.withColumn("rate", F.lit(None).cast("double")), str(tmp_path / "report"))
    assert "null" in "".join(p.read_text() for p in (tmp_path / "report").glob("*.json"))


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    sqlfuncs.register(spark)
    assert spark.sql("SELECT pass_at_k(8, 3, 4) AS p").first().p == pytest.approx(1 - 5 / 70)
    assert spark.sql("SELECT mcnemar_exact_p(9, 1) AS p").first().p == pytest.approx(22 / 1024)
    assert spark.sql("SELECT strip_trailing_ref('Fix x (#12)') AS t").first().t == "Fix x"
    rows = spark.sql("SELECT * FROM parse_test_log('a.py::t PASSED\\nb FAILED\\na.py::t FAILED')").collect()
    assert [(r.test, r.status) for r in rows] == [("a.py::t", "FAILED")]


@pytest.mark.parametrize("body,issue", [("Fixes #12", 12), ("closes [#3](x)", 3), ("<!-- fixes #9 -->", None), ("fix https://github.com/o/r/issues/5", 5), ("fix https://github.com/p/q/issues/5 and closes #8", 8), (None, None), ("see #4", None)])
def test_linked_issue(spark, body, issue):
    assert value(spark, X.linked_issue(F.lit(body).cast("string"), F.lit("O/R"))) == issue


@pytest.mark.parametrize("before,after", [("Fix X (#12)", "Fix X"), ("uses C#9 and RFC#7231", "uses C#9 and RFC#7231"), ("see gorilla#739 now", "see  now"), ("cherry-pick c3535905 done", " done"), ("Fixes #3", "")])
def test_strip_info_leak(spark, before, after):
    assert value(spark, X.strip_info_leak(F.lit(before))) == after


def test_reflow(spark):
    assert value(spark, X.reflowed(F.lit("a\n\n\n\nb\n## Checklist\n- x"))) == "a\n\nb"
    assert value(spark, X.reflowed(F.lit("x" * 5000))).endswith("…(truncated)")


@pytest.mark.parametrize("path,test", [("docs/testing.md", False), ("src/click/testing.py", False), ("tests/a.txt", True), ("conftest.py", True), ("a/b_test.go", True), ("src/view.spec.ts", True), ("my dir/test_x.py", True), ("", False), (None, False)])
def test_paths(spark, path, test):
    assert value(spark, X.is_test_path(F.lit(path).cast("string"))) is test


def test_quoted_diff_paths(spark):
    block = 'diff --git "a/na\\303\\257ve x.py" "b/na\\303\\257ve x.py"\n--- a'
    assert value(spark, X.diff_path(F.lit(block), "b")) == "naïve x.py"
    assert value(spark, X.diff_path(F.lit("diff --git a/my file.py b/my file.py\n"), "a")) == "my file.py"


def test_word_count_is_unicode(spark):
    assert value(spark, X.word_count(F.lit("one two_3 é-acute"))) == 4


def test_materialized_tables_are_released(spark):
    from spanwright.runtime import materialize, release

    df = materialize(spark.range(5), "five")
    assert df.count() == 5 and release(spark) >= 1 and release(spark) == 0
