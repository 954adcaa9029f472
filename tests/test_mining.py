"""Task folders and their audit, leaked names, sequences of skip reasons, runners."""

import pytest
from pyspark.sql import functions as F

from spanwright.operators import mining as M
from spanwright.operators import testlogs as L
from spanwright.sources import files

BASE = "0123456789" * 4
TOML = f'[metadata.repo2env.pr_runtime]\nbase_commit = "{BASE}"\nfail_to_pass = ["tests/test_a.py::T::test_one[x]"]\n'
DOCKER = f"FROM x\nRUN git reset --hard {BASE}\nRUN git remote remove origin && git branch -D a && git tag -d b && git reflog expire && git gc --prune=now\nRUN git clean -fd --exclude=x\nRUN apt-get install -y tmux\n"
TEST = "git apply - <<EOF\n--- a/tests/test_a.py\n+++ b/tests/test_a.py\n+def test_one():\nEOF\npytest"


def write(folder, **parts):
    for name, text in parts.items():
        path = folder / {v: k for k, v in files.TASK_FILES.items()}[name]
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture(scope="module")
def audit(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tasks")
    good = dict(task_toml=TOML, dockerfile=DOCKER, test_sh=TEST, oracle="--- a/src/a.py\n+++ b/src/a.py\n+x\n", f2p_json='["tests/test_a.py::T::test_one[x]"]')
    write(d / "good", **good)
    write(d / "comment", **{**good, "dockerfile": DOCKER.replace("RUN apt-get install -y tmux", "# tmux").replace("clean -fd ", "clean -fdX ")})
    write(d / "orphan", **{**good, "task_toml": TOML.replace("test_a.py::T::test_one", "test_b.py::T::test_two")})
    write(d / "leaky", **{**good, "oracle": "+++ b/tests/test_a.py\n+x\n"})
    write(d / "go", **{**good, "task_toml": TOML.replace("tests/test_a.py::T::test_one[x]", "test_one/sub"), "f2p_json": "oops"})
    write(d / "untitled", dockerfile=DOCKER)
    write(d / "broken", task_toml="= =")
    write(d / "shallow", task_toml='[metadata]\nrepo2env = "bad"\n')
    rows = M.task_audit(files.task_folders(spark, str(d))).collect()
    found = {}
    for r in rows:
        found.setdefault(r.task, {})[r.check] = r.ok
    return found


def test_a_sound_task_passes(audit):
    assert len(audit["good"]) == 11 and all(audit["good"].values())


@pytest.mark.parametrize("task,failed", [
    ("comment", {"dockerfile_installs_tmux", "git_clean_preserves_build_artifacts"}),
    ("orphan", {"f2p_files_in_test_patch", "f2p_names_in_test_patch", "shipped_f2p_matches_task_toml"}),
    ("leaky", {"oracle_excludes_test_files"}),
    ("go", {"shipped_f2p_matches_task_toml"}),
])
def test_faults_are_found(audit, task, failed):
    assert {k for k, ok in audit[task].items() if not ok} == failed
    assert ("f2p_files_in_test_patch" in audit[task]) == (task != "go")  # ids that name no file aren't asked for one


def test_descriptions_that_cannot_be_read(audit):
    assert audit["untitled"] == {"task_toml_present": False}
    assert audit["broken"] == {"task_toml_parses": False}
    assert audit["shallow"]["metadata_well_formed"] is False


def diff(*parts):
    return "".join(f"diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n@@ -1 +1 @@\n{body}\n" for p, body in parts)


def test_leaked_names(spark):
    text = diff(("src/flow_engine.py", "+def _resolve_all():\n+def run():\n-def gone_name():"), ("tests/test-core.x.py", "+class TestCase:"))
    said = ["calls _resolve_all twice", "the flow_engine and run", "test-core.x is red", "gone_name and flow engine", "resolve_all"]
    rows = spark.createDataFrame([(i, s, text) for i, s in enumerate(said)] + [(9, None, None)], "id int, instruction string, diff string")
    found = {}
    for r in M.leaked_identifiers(rows.where("instruction is not null"), rows).collect():
        found.setdefault(r.id, []).append(r.name)
    assert found == {0: ["_resolve_all"], 1: ["flow_engine"]}


def test_commit_sequence(spark):
    source, test = ("src/parse_rows.py", "+x"), ("tests/test_a.py", "+def test_new():\n+    pass")
    schema = "id int, parents array<string>, author_name string, author_email string, subject string, body string, diff string, n_fail_to_pass int"
    row = lambda i, d, subject="Repair the reader of empty files today", n=1, parents=("p",), author="Dev": (i, list(parents), author, "d@x", subject, "body", d, n)
    data = [
        row(0, diff(source, test)), row(1, diff(source, test), parents=()), row(2, diff(test)), row(3, diff(source)), row(4, diff((".github/a.yml", "+x"), test)), row(5, diff(source, ("tests/test_a.py", "+# typo"))),
        row(6, diff(source, test), n=0), row(7, diff(source, test), "Repair parse_rows for empty input files"), row(8, diff(source, test), n=None), row(9, None), row(10, diff(source, test), author="renovate[bot]"),
    ]
    found = {r.id: r.reason for r in M.commit_sequence(spark.createDataFrame(data, schema)).collect()}
    assert found == {0: None, 1: "root_commit", 2: "empty_source_patch", 3: "no_test_patch", 4: "ci_only_patch", 5: "no_new_test_funcs", 6: "no_fail_to_pass", 7: "instruction_leaked", 8: None, 9: "empty_source_patch", 10: "excluded_author"}


def test_runner_of_commands(spark):
    said = [("python -m pytest -v", "go", "pytest"), ("go  test ./...", None, "go"), ("make check", "Rust", "cargo"), ("yarn test", "python", "jest"), ("cargo test", None, "cargo"), (None, "node", "jest"), ("make", None, "unknown"), ("ergo test", "ada", "unknown")]
    rows = spark.createDataFrame([(c, l, w) for c, l, w in said], "c string, l string, w string")
    assert all(r.ok for r in rows.select((L.runner_of_command(F.col("c"), F.col("l")) == F.col("w")).alias("ok")).collect())


def test_nested_headers(spark):
    log = "PASS src/a.test.ts\n  outer\n    inner\n      ✓ one (2 ms)\n      ✕ two\n    other\n      ○ skipped: three\n  ✓ four\nPASS src/b.test.ts\n  ✓ five\nTests: 5"
    rows = L.jest_status(spark.createDataFrame([(1, log)], "log_id int, log string")).collect()
    assert {(r.test, r.status) for r in rows} == {
        ("src/a.test.ts > outer > inner > one", "PASSED"), ("src/a.test.ts > outer > inner > two", "FAILED"), ("src/a.test.ts > outer > other > three", "SKIPPED"),
        ("src/a.test.ts > four", "PASSED"), ("src/b.test.ts > five", "PASSED"),
    }
