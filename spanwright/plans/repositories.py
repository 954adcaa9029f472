"""Queries of the mining family: test logs, diffs, pull requests, commits, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions import text as X
from spanwright.operators import mining as M
from spanwright.operators import testlogs as L
from spanwright.plans.views import oracle, rounded, view

REPO = "acme/widget"


def _logs(spark, sf_dir):
    return view(spark, sf_dir, "documents").where((F.col("kind") == "test_log") & F.col("text").isNotNull()).select(F.col("doc_id").alias("log_id"), F.col("text").alias("log"))


def _rendered(spark, sf_dir, line):
    """Each user's events as one runner's log."""
    lines = view(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), "event_id", line.alias("line"))
    return lines.groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("log"))


def _status(names):
    return F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in names.items()))


def q_s10_pytest_status(spark, sf_dir):
    return L.pytest_status(_logs(spark, sf_dir))


def q_s11_go_status(spark, sf_dir):
    name = F.concat(F.lit("TestU/case_"), (F.col("event_id") % 10).cast("string"))
    line = F.concat(F.lit("    --- "), _status({"view": "PASS", "click": "FAIL", "purchase": "SKIP", "signup": "PASS", "error": "NOTE"}), F.lit(": "), name, F.lit(" (0.01s)"))
    return L.go_status(_rendered(spark, sf_dir, line))


def q_s12_cargo_status(spark, sf_dir):
    name = F.concat(F.lit("mod::case_"), (F.col("event_id") % 10).cast("string"))
    line = F.concat(F.lit("test "), name, F.lit(" ... "), _status({"view": "ok", "click": "FAILED", "purchase": "ignored", "signup": "ok", "error": "bench"}))
    return L.cargo_status(_rendered(spark, sf_dir, line))


def q_f09_jest_status(spark, sf_dir):
    """Errors start a file, signups are headers, the rest are tests."""
    n = (F.col("event_id") % 10).cast("string")
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("PASS src/f"), (F.col("event_id") % 3).cast("string"), F.lit(".test.ts (5 ms)")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("  block "), n))
        .otherwise(F.concat(F.lit("    "), F.when(F.col("event_type") == "view", "✓").when(F.col("event_type") == "click", "✕").otherwise("○"), F.lit(" case "), n, F.lit(" (3 ms)")))
    )
    return L.jest_status(_rendered(spark, sf_dir, line))


def q_s13_runner(spark, sf_dir):
    logs = view(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return logs.groupBy("kind").agg(F.count_if(L.runner_of(F.col("text")) == "pytest").alias("pytest"), F.count("*").alias("n"))


def _halves(spark, sf_dir):
    """A log's lines before and after a patch: its first and second half."""
    lines = L.log_lines(_logs(spark, sf_dir))
    size = lines.groupBy("log_id").agg(F.max("line_no").alias("last"))
    return lines.join(size, "log_id").withColumn("late", F.col("line_no") * 2 > F.col("last"))


def _half(spark, sf_dir, late):
    rows = _halves(spark, sf_dir).where(F.col("late") == late)
    logs = rows.groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("log"))
    return L.pytest_status(logs)


def q_d19_transitions(spark, sf_dir):
    return L.transitions(_half(spark, sf_dir, False), _half(spark, sf_dir, True))


def q_d20_grade(spark, sf_dir):
    """Tests declared by the logs' two halves, graded by the whole log."""
    return rounded(L.grades(q_d19_transitions(spark, sf_dir), L.pytest_status(_logs(spark, sf_dir))))


def q_s02_word_count(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.regexp_count("text", F.lit(r"[a-z]+")).alias("lower_words"), X.changed_lines(F.col("text")).alias("changed"))


def q_s02_unicode_words(spark, sf_dir):
    return view(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", X.word_count(F.col("text")).alias("words"))


def q_s04_strip_leaks(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    clean = X.strip_info_leak(F.col("text"))
    return docs.select("doc_id", F.length(clean).alias("n"), (F.length("text") - F.length(clean)).alias("removed"))


def q_s05_reflow(spark, sf_dir):
    return view(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.length(X.reflowed(F.col("text"))).alias("n"))


def _diffs(spark, sf_dir):
    """The files of each pull request as one diff."""
    lines = F.concat(F.lit("+"), F.replace("content", F.lit("\n"), F.lit("\n+")))
    block = F.concat(F.lit("diff --git a/"), F.col("path"), F.lit(" b/"), F.col("path"), F.lit("\n--- a/"), F.col("path"), F.lit("\n+++ b/"), F.col("path"), F.lit("\n@@ -0,0 +1 @@\n"), lines, F.lit("\n"))
    blocks = view(spark, sf_dir, "v_patch_files").select("number", "path", F.struct("k", block.alias("b")).alias("x"))
    return blocks.groupBy("number").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "").alias("diff"), F.collect_set("path").alias("changed_files"))


def _prs(spark, sf_dir):
    return view(spark, sf_dir, "v_pulls").drop("m", "text").join(_diffs(spark, sf_dir), "number", "left")


def q_s03_linked_issue(spark, sf_dir):
    return view(spark, sf_dir, "v_pulls").select("number", X.linked_issue(F.col("body"), F.lit(REPO)).alias("issue"))


def q_c11_pr_reasons(spark, sf_dir):
    return _prs(spark, sf_dir).select("number", M.pr_reason(F.lit(REPO), 20).alias("reason"))


def q_c14_pr_sequence(spark, sf_dir):
    return M.pr_sequence(_prs(spark, sf_dir), F.lit(REPO), min_words=20, max_files=2).select("number", "reason")


def q_c13_lite_sequence(spark, sf_dir):
    """The same with the rules of light tasks."""
    return M.pr_sequence(_prs(spark, sf_dir), F.lit(REPO), max_files=2, light=True).select("number", "reason")


def q_e09_skip_hist(spark, sf_dir):
    return M.skip_histogram(q_c14_pr_sequence(spark, sf_dir))


def _commits(spark, sf_dir):
    parents = F.transform(F.sequence(F.lit(1), F.col("n_parents")), lambda x: x.cast("string"))
    return _prs(spark, sf_dir).select("number", F.when(F.col("n_parents") > 0, parents).otherwise(F.array().cast("array<string>")).alias("parents"), F.col("title").alias("subject"), "body", "author_name", F.lit("d@example.org").alias("author_email"), "diff", "n_fail_to_pass")


def q_c15_commit_reasons(spark, sf_dir):
    return _commits(spark, sf_dir).select("number", M.commit_reason(min_words=8, min_problem_words=30, bugfix_only=True).alias("reason"))


def q_c17_commit_sequence(spark, sf_dir):
    found = M.commit_sequence(_commits(spark, sf_dir), min_words=8, max_files=2)
    return found.select("number", "reason", F.array_join("leaked", ",").alias("leaked"))


def _paths(spark, sf_dir):
    k = F.col("p_partkey")
    folder = F.coalesce(*(F.when(k % 8 == i, p) for i, p in enumerate(("src/", "tests/", "docs/test/", "a/Testing/", "", "lib/e2e/", "examples/", "x/__tests__/"))))
    name = F.coalesce(*(F.when(F.floor(k / 8) % 7 == i, p) for i, p in enumerate(("core.py", "test_core.py", "core_test.go", "conftest.py", "view.spec.ts", "testing.md", "a b.test.js"))))
    return view(spark, sf_dir, "part").select(k.alias("id"), F.concat(folder, name).alias("path"))


def q_c19_path_class(spark, sf_dir):
    return _paths(spark, sf_dir).select("id", "path", X.is_test_path(F.col("path")).alias("is_test"))


def q_s06_diff_split(spark, sf_dir):
    """Parts of an order as the files of its diff."""
    lines = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_partkey").alias("part"))
    block = F.concat(F.lit("diff --git a/"), F.col("path"), F.lit(" b/"), F.col("path"), F.lit("\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-old\n+new\n+def test_"), F.col("l_linenumber").cast("string"), F.lit("():\n"))
    diffs = lines.join(_paths(spark, sf_dir).withColumnRenamed("id", "part"), "part").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", block.alias("b")))), lambda x: x["b"]), "").alias("diff"))
    return M.structural_reasons(M.diff_files(diffs)).select("id", "n_source", "n_test", "new_tests", "loc", "reason")


def q_d28_leaked_identifiers(spark, sf_dir):
    """Names that each pull request introduces and its own text uses."""
    prs = _prs(spark, sf_dir).where(F.col("diff").isNotNull())
    return M.leaked_identifiers(prs.select(F.col("number").alias("id"), F.col("body").alias("instruction")), prs.select(F.col("number").alias("id"), "diff"))


def q_c34_audit(spark, sf_dir):
    return M.task_audit(view(spark, sf_dir, "v_tasks"))


def q_e08_audit_hist(spark, sf_dir):
    return M.task_audit(view(spark, sf_dir, "v_tasks")).where(~F.col("ok")).groupBy("check").agg(F.count("*").alias("n"))


def _commands(spark, sf_dir):
    """The shell commands that runs called for, with a language by a digest of the run."""
    calls = view(spark, sf_dir, "v_turns").select("run_id", "turn_id", F.posexplode("tool_calls").alias("pos", "c")).where(F.col("c.args").contains("command"))
    language = F.element_at(F.array(*(F.lit(x) for x in ("python", "Go", "rust", "node", "cobol"))), F.pmod(F.ascii(F.md5("run_id")), F.lit(5)) + 1)
    return calls.select("turn_id", "pos", F.col("c.args").alias("commands"), language.alias("language"))


def q_s13_runner_of_command(spark, sf_dir):
    rows = _commands(spark, sf_dir).where(F.col("language").isNotNull())
    return rows.groupBy("language", L.runner_of_command(F.col("commands")).alias("named"), L.runner_of_command(F.col("commands"), F.col("language")).alias("runner")).agg(F.count("*").alias("n"))


def q_s13_parsed_logs(spark, sf_dir):
    """Every text read by the parser of the runner whose marks it bears."""
    docs = view(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    logs = docs.select(F.col("doc_id").alias("log_id"), L.runner_of(F.col("text")).alias("runner"), F.col("text").alias("log"))
    return L.parsed_logs(logs).groupBy("status").agg(F.count("*").alias("n"))


def q_c36_difficulty(spark, sf_dir):
    rows = view(spark, sf_dir, "lineitem")
    return rows.groupBy(M.difficulty(F.col("l_quantity") * 2, F.col("l_linenumber")).alias("difficulty")).agg(F.count("*").alias("n"))


def q_s19_repo_slug(spark, sf_dir):
    k = F.col("c_custkey")
    url = F.coalesce(*(F.when(k % 5 == i, F.concat(F.lit(a), F.col("c_custkey").cast("string"), F.lit(b))) for i, (a, b) in enumerate((("https://github.com/Own/r", ".git"), ("git@github.com:own/r", ""), ("own/r", ""), ("http://github.com/own/r", "/tree/main"), ("ssh://git@github.com/own/r", ".git")))))
    return view(spark, sf_dir, "customer").select("c_custkey", X.repo_slug(url).alias("slug"))


_LOGS = "logs AS (SELECT doc_id AS log_id, text AS log FROM documents WHERE kind = 'test_log' AND text IS NOT NULL)"
_LINES = _LOGS + ", lines AS (SELECT log_id, unnest(string_split(log, chr(10))) AS line, unnest(range(0, len(string_split(log, chr(10))))) AS line_no FROM logs)"


def _pytest(source: str, name: str) -> str:
    return rf"""{name}_l AS (SELECT log_id, line_no, trim(line, E' \t\r\n\x0b\x0c') AS line FROM {source}),
{name}_w AS (SELECT log_id, line_no, line, regexp_extract(line, '^(PASSED|FAILED|SKIPPED|ERROR)(?: |$)', 1) AS lead_status, regexp_extract(line, '^(\S+)\s+(PASSED|FAILED|SKIPPED|ERROR)\b', ['n', 's']) AS v FROM {name}_l),
{name}_t AS (SELECT *, list_filter(string_split_regex(CASE WHEN lead_status = 'FAILED' THEN split_part(line, ' - ', 1) ELSE line END, '\s+'), lambda x: x <> '') AS tk FROM {name}_w),
{name}_f AS (SELECT log_id, line_no, CASE WHEN lead_status <> '' THEN CASE WHEN starts_with(tk[2], '[') AND ends_with(tk[2], ']') THEN tk[3] ELSE tk[2] END WHEN v.n <> '' AND (contains(v.n, '::') OR ends_with(v.n, '.py')) THEN v.n END AS test, CASE WHEN lead_status <> '' THEN lead_status ELSE v.s END AS status FROM {name}_t),
{name} AS (SELECT log_id, test, arg_max(status, line_no) AS status FROM {name}_f WHERE test IS NOT NULL GROUP BY 1, 2)"""


_HALF = _LINES + """, marked AS (SELECT *, line_no * 2 > max(line_no) OVER (PARTITION BY log_id) AS late FROM lines), early AS (SELECT * FROM marked WHERE NOT late), late AS (SELECT * FROM marked WHERE late), """ + _pytest("early", "pre") + ", " + _pytest("late", "post") + """,
trans AS (SELECT a.log_id, a.test, CASE WHEN a.status IN ('FAILED', 'ERROR') AND b.status = 'PASSED' THEN 'fail_to_pass' WHEN a.status = 'PASSED' AND b.status = 'PASSED' THEN 'pass_to_pass' END AS kind FROM pre a LEFT JOIN post b ON b.log_id = a.log_id AND b.test = a.test)"""
_WORDS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\x{{200c}}\x{{200d}}]+'))"
_BLANK = r"[\t\n\x0b\f\r \x{85}\p{Z}]"


def _stripped(text: str) -> str:
    for pattern in X.LEAKS:
        text = f"regexp_replace({text}, '{pattern}', '', 'g')"
    return text


_LINK = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+(?:\[?#(\d+)|https?://(?:\w+\.)?github\.com/([\w.-]+)/([\w.-]+)/issues/(\d+))"
_IS_TEST = r"NOT regexp_matches(lower({0}), '^(?:docs|doc|documentation|examples|example)/') AND (regexp_matches(lower({0}), '(?:^|/)(?:test|tests|testing|e2e|__tests__)/') OR regexp_matches(split_part(lower({0}), '/', -1), '^conftest\.py$|^test_.*\.(?:py|js|ts)$|_test\.(?:py|go)$|\.(?:test|spec)\.(?:ts|js)$'))"
_TITLE = r"""(?i)\b(?:back[-\s]?port|cherry[-\s]?pick|revert|bump|release|changelog|forward[-\s]?merge|prepare\s+(?:for\s+)?release|version\s+bump|re-?sync)\b|\bmerge\b[^\n]*\binto\b|\bmerge\s+(?:branch|stable|main|master|develop|upstream|release)\b|\bsync\s+(?:stable|main|master|branch|develop|upstream)\b"""
_PR = rf"""bare AS (SELECT *, regexp_replace(body, '(?s)<!--.*?-->', '', 'g') AS t FROM {{v_pulls}}),
links AS (SELECT *, list_zip(regexp_extract_all(t, '{_LINK}', 1), regexp_extract_all(t, '{_LINK}', 2), regexp_extract_all(t, '{_LINK}', 3), regexp_extract_all(t, '{_LINK}', 4)) AS z FROM bare),
pr AS (SELECT *, list_filter(z, lambda x: x[1] <> '' OR lower(concat(x[2], '/', x[3])) = 'acme/widget')[1] AS own FROM links),
linked AS (SELECT *, TRY_CAST(coalesce(nullif(own[1], ''), nullif(own[4], '')) AS INT) AS issue FROM pr),
rs AS (SELECT *, CASE WHEN is_draft THEN 'draft' WHEN merged_at IS NULL THEN 'not_merged' WHEN no_files THEN 'no_files' WHEN regexp_matches(title, '{_TITLE}') THEN 'non_bug_pr' WHEN issue IS NULL THEN 'no_linked_issue' END AS pre,
  {_WORDS.format("body")} AS words FROM linked)"""
_FILES = rf"""fs AS (SELECT *, {_IS_TEST.format("path")} AS is_test FROM {{v_patch_files}}),
facts AS (SELECT number, count(DISTINCT path) FILTER (NOT is_test) AS n_source, count(*) FILTER (is_test) AS n_test, bool_and(starts_with(path, '.github/')) FILTER (NOT is_test) AS ci,
  sum(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\s*(?:def\s+test_\w+|class\s+\w*[Tt]est\w*|func\s+Test\w+|it\s*\(|test\s*\(|describe\s*\()')))) FILTER (is_test) AS new_tests FROM fs GROUP BY 1)"""
_SEQ = rf"""{_PR}, {_FILES},
steps AS (SELECT r.*, coalesce(n_source, 0) AS n_source, CASE WHEN coalesce(n_source, 0) = 0 THEN 'empty_source_patch' WHEN n_test = 0 THEN 'no_test_patch' WHEN ci THEN 'ci_only_patch' END AS shape, CASE WHEN new_tests < 1 THEN 'no_new_test_funcs' END AS tests,
  CASE WHEN n_source > 2 THEN 'too_many_source_files' END AS many, CASE WHEN n_fail_to_pass < 1 THEN 'no_fail_to_pass' END AS turned FROM rs r LEFT JOIN facts f ON f.number = r.number),
seq AS (SELECT *, coalesce(pre, CASE WHEN words < 20 THEN 'problem_statement_too_short' END, shape, tests, many, turned) AS reason,
  coalesce(pre, shape, tests, many, CASE WHEN n_source <> 1 THEN 'lite_not_single_source_file' WHEN words < 40 THEN 'lite_problem_too_short' WHEN regexp_matches(lower(body), '!\[[^\]]*\]\(|<img\s') THEN 'lite_has_image'
    WHEN len(list_filter(regexp_extract_all(lower(body), '\bhttps?://(.{{0,11}})', 1), lambda x: x <> 'github.com/')) > 0 THEN 'lite_has_external_link' WHEN regexp_matches(lower(body), '\b[a-f0-9]{{7,40}}\b') THEN 'lite_has_commit_sha' END, turned) AS light FROM steps)"""
_CM = rf"""cm AS (SELECT *, concat(title, chr(10), body) AS message, {_WORDS.format("concat(title, chr(10), body)")} AS said FROM {{v_pulls}}),
meta AS (SELECT *, CASE WHEN n_parents > 1 THEN 'merge_commit' WHEN n_parents = 0 THEN 'root_commit' WHEN regexp_matches(lower(author_name), 'dependabot|renovate|pre-commit-ci') THEN 'excluded_author' WHEN said < 8 THEN 'message_too_short'
  WHEN regexp_matches(title, '(?i)^(?:chore|docs|feat|refactor|style|test|ci|build|perf|revert)(?:\([^)]+\))?!?:') THEN 'non_bug_type' END AS basic,
  regexp_matches(title, '(?i)^fix(?:\([^)]+\))?!?:') OR regexp_matches(message, '(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+\[?#\d+') OR regexp_matches(title, '(?i)\b(?:fix(?:e[sd])?|fixing|bug(?:fix|s)?|regression|crash(?:e[sd]|ing)?|broken|incorrect(?:ly)?|wrong(?:ly)?|fail(?:s|ed|ing|ure)?|defect|hotfix|raise[sd]?|error|exception|traceback|leak|deadlock|race)\b') AS fixes FROM cm)"""
_NAMES = r"""defs AS (SELECT number, unnest(regexp_extract_all(content, '(?m)^\s*(?:def|class|func|fn|type|struct|interface)\s+([A-Za-z_][0-9A-Za-z_]*)', 1)) AS name FROM {v_patch_files}),
stems AS (SELECT number, regexp_replace(split_part(path, '/', -1), '(.)\.[^.]*$', '\1') AS name FROM {v_patch_files}),
names AS (SELECT DISTINCT number, name FROM (SELECT * FROM defs UNION ALL SELECT * FROM stems) WHERE length(name) >= 5 AND (contains(name, '_') OR regexp_matches(name, '[a-z][A-Z]')))"""
_PATH = """paths AS (SELECT p_partkey AS id, ['src/', 'tests/', 'docs/test/', 'a/Testing/', '', 'lib/e2e/', 'examples/', 'x/__tests__/'][p_partkey % 8 + 1] AS d, ['core.py', 'test_core.py', 'core_test.go', 'conftest.py', 'view.spec.ts', 'testing.md', 'a b.test.js'][(p_partkey // 8) % 7 + 1] AS b FROM part),
cls AS (SELECT id, concat(d, b) AS path, d NOT IN ('docs/test/', 'examples/') AND (d IN ('tests/', 'a/Testing/', 'lib/e2e/', 'x/__tests__/') OR b IN ('test_core.py', 'core_test.go', 'conftest.py', 'view.spec.ts', 'a b.test.js')) AS is_test FROM paths)"""
_AUDIT = r"""parsed AS (SELECT *, CASE WHEN task_toml IS NULL THEN NULL ELSE NOT starts_with(task_toml, 'not') END AS parses, regexp_extract(task_toml, 'base_commit = "([^"]*)"', 1) AS base, regexp_extract_all(regexp_extract(task_toml, 'fail_to_pass = \[(.*)\]', 1), '"([^"]*)"', 1) AS ids,
  regexp_extract_all(test_sh, '(?m)^\+\+\+ b/([^\n]+)$', 1) AS patched, array_to_string(list_filter(string_split(test_sh, chr(10)), lambda x: regexp_matches(x, '^[-+ ]')), chr(10)) AS body, regexp_extract_all(oracle, '(?m)^\+\+\+ b/([^\n]+)$', 1) AS fixed FROM {v_tasks}),
declared AS (SELECT *, list_filter(list_transform(ids, lambda x: regexp_extract(x, '^([^\s:>#]+?\.(?:py|js|jsx|ts|tsx|go|rs|java|kt|scala|rb|php|cs|c|cc|cpp))(?:[:>#]|$)', 1)), lambda f: f <> '') AS files,
  list_transform(ids, lambda x: split_part(split_part(list_filter(string_split_regex(x, '::|[#>.]'), lambda p: p <> '')[-1], '[', 1), '/', 1)) AS symbols FROM parsed),
a0 AS (SELECT task, unnest(['base_commit_declared', 'dockerfile_resets_to_base_commit', 'git_history_scrubbed', 'git_clean_preserves_build_artifacts', 'dockerfile_installs_tmux', 'f2p_declared', 'f2p_files_in_test_patch', 'f2p_names_in_test_patch', 'shipped_f2p_matches_task_toml', 'oracle_patch_present', 'oracle_excludes_test_files', 'metadata_well_formed']) AS "check",
  unnest([length(base) = 40, base <> '' AND contains(dockerfile, concat('git reset --hard ', base)), contains(dockerfile, 'git gc --prune=now'), NOT regexp_matches(dockerfile, 'git clean -[a-z]*x'),
    regexp_matches(dockerfile, '(?m)^\s*RUN\b[^\n]*\btmux\b'), len(ids) > 0, CASE WHEN len(files) > 0 THEN len(patched) > 0 AND len(list_filter(files, lambda f: NOT list_contains(patched, f))) = 0 END,
    CASE WHEN len(ids) > 0 THEN trim(body) <> '' AND len(list_filter(symbols, lambda s: NOT contains(body, s))) = 0 END, CASE WHEN json_valid(f2p_json) THEN list_sort(from_json(f2p_json, '["VARCHAR"]')) ELSE [] END = list_sort(ids),
    trim(oracle) <> '', len(list_intersect(fixed, patched)) = 0, CASE WHEN contains(task_toml, 'repo2env = "bad"') THEN false END]) AS ok FROM declared WHERE parses),
a AS (SELECT * FROM a0 WHERE ok IS NOT NULL UNION ALL SELECT task, CASE WHEN parses IS NULL THEN 'task_toml_present' ELSE 'task_toml_parses' END, false FROM parsed WHERE parses IS NULL OR NOT parses)"""

QUERIES = {name: f for name, f in dict(globals()).items() if name.startswith("q_")}
SQL = {
    "q_s10_pytest_status": f"WITH {_LINES}, {_pytest('lines', 'st')} SELECT * FROM st",
    "q_s11_go_status": "SELECT user_id AS log_id, concat('TestU/case_', event_id % 10) AS test, arg_max(CASE event_type WHEN 'view' THEN 'PASSED' WHEN 'signup' THEN 'PASSED' WHEN 'click' THEN 'FAILED' ELSE 'SKIPPED' END, event_id) AS status FROM events WHERE event_type <> 'error' GROUP BY 1, 2",
    "q_s12_cargo_status": "SELECT user_id AS log_id, concat('mod::case_', event_id % 10) AS test, arg_max(CASE event_type WHEN 'view' THEN 'PASSED' WHEN 'signup' THEN 'PASSED' WHEN 'click' THEN 'FAILED' ELSE 'SKIPPED' END, event_id) AS status FROM events WHERE event_type <> 'error' GROUP BY 1, 2",
    "q_f09_jest_status": "WITH e AS (SELECT *, count(*) FILTER (event_type = 'error') OVER w AS sec, last_value(CASE WHEN event_type = 'error' THEN concat('src/f', event_id % 3, '.test.ts') END IGNORE NULLS) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), h AS (SELECT *, last_value(CASE WHEN event_type = 'signup' AND f IS NOT NULL THEN concat('block ', event_id % 10) END IGNORE NULLS) OVER (PARTITION BY user_id, sec ORDER BY event_id) AS b FROM e) SELECT user_id AS log_id, concat_ws(' > ', f, b, concat('case ', event_id % 10)) AS test, arg_max(CASE event_type WHEN 'view' THEN 'PASSED' WHEN 'click' THEN 'FAILED' ELSE 'SKIPPED' END, event_id) AS status FROM h WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2",
    "q_s13_runner": r"SELECT kind, count(*) FILTER (NOT regexp_matches(text, '(?m)^\s*--- (?:PASS|FAIL|SKIP): ') AND NOT regexp_matches(text, '(?m)^test \S+ \.\.\. (?:ok|FAILED|ignored)') AND NOT regexp_matches(text, '(?m)^(?:PASS|FAIL)\s+\S+\.(?:ts|tsx|js|jsx|mjs|cjs)') AND regexp_matches(text, '(?m)::\S+\s+(?:PASSED|FAILED|SKIPPED|ERROR)|^(?:PASSED|FAILED|SKIPPED|ERROR) ')) AS pytest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "q_d19_transitions": f"WITH {_HALF} SELECT * FROM trans WHERE kind IS NOT NULL",
    "q_d20_grade": f"WITH {_HALF}, {_pytest('lines', 'st')}, d AS (SELECT * FROM trans WHERE kind IS NOT NULL), j AS (SELECT coalesce(d.log_id, st.log_id) AS log_id, kind, status, coalesce(status = 'PASSED', false) AS ok FROM d FULL JOIN st ON st.log_id = d.log_id AND st.test = d.test), g AS (SELECT log_id, count(*) FILTER (kind = 'fail_to_pass') AS f2p_total, count(*) FILTER (kind = 'fail_to_pass' AND ok) AS f2p_passed, count(*) FILTER (kind = 'pass_to_pass') AS p2p_total, count(*) FILTER (kind = 'pass_to_pass' AND ok) AS p2p_passed, count(*) FILTER (kind IS NULL AND status = 'FAILED') AS untracked FROM j GROUP BY 1), r AS (SELECT *, coalesce(f2p_passed / nullif(f2p_total, 0), 0) AS a, coalesce(p2p_passed / nullif(p2p_total, 0), 1) AS b FROM g) SELECT log_id, f2p_total, f2p_passed, p2p_total, p2p_passed, untracked, round_even(a, 6) AS f2p_rate, round_even(b, 6) AS p2p_rate, round_even(a * b, 6) AS reward, f2p_total > 0 AND f2p_passed = f2p_total AND p2p_passed = p2p_total AS resolved FROM r",
    "q_s02_word_count": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-z]+')) AS INT) AS lower_words, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[+-]') AND NOT regexp_matches(x, '^(?:\+\+\+|---) '))) AS INT) AS changed FROM documents WHERE text IS NOT NULL",
    "q_s02_unicode_words": f"SELECT doc_id, CAST({_WORDS.format('text')} AS INT) AS words FROM documents WHERE text IS NOT NULL",
    "q_s04_strip_leaks": f"SELECT doc_id, CAST(length(clean) AS INT) AS n, CAST(length(text) - length(clean) AS INT) AS removed FROM (SELECT doc_id, text, {_stripped('text')} AS clean FROM documents WHERE text IS NOT NULL)",
    "q_s05_reflow": rf"""WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '\r\n|\n|\r') AS l FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: regexp_matches(x, '{X.NOISE_HEADER}')), true) AS noise FROM d),
j AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(CASE WHEN noise > 0 THEN l[1:noise - 1] ELSE l END, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS t FROM k)
SELECT doc_id, CAST(CASE WHEN length(t) > 4000 THEN length(regexp_replace(substr(t, 1, 4000), '{_BLANK}+$', '')) + 14 ELSE length(t) END AS INT) AS n FROM j""",
    "q_s03_linked_issue": f"WITH {_PR} SELECT number, issue FROM linked",
    "q_c11_pr_reasons": f"WITH {_PR} SELECT number, coalesce(pre, CASE WHEN words < 20 THEN 'problem_statement_too_short' END) AS reason FROM rs",
    "q_c14_pr_sequence": f"WITH {_SEQ} SELECT number, reason FROM seq",
    "q_c13_lite_sequence": f"WITH {_SEQ} SELECT number, light AS reason FROM seq",
    "q_d28_leaked_identifiers": f"WITH {_NAMES} SELECT n.number AS id, name FROM names n JOIN {{v_pulls}} p ON p.number = n.number WHERE regexp_matches(body, concat('(?:^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])', name, '(?:$|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])'))",
    "q_s13_runner_of_command": r"""WITH c AS (SELECT run_id, unnest(tool_calls).args AS args FROM {v_turns}), k AS (SELECT lower(args) AS a, ['python', 'Go', 'rust', 'node', 'cobol'][ascii(md5(run_id)) % 5 + 1] AS language FROM c WHERE contains(args, 'command') AND run_id IS NOT NULL),
n AS (SELECT language, CASE WHEN contains(a, 'pytest') THEN 'pytest' WHEN regexp_matches(a, '\bgo\s+test\b') THEN 'go' WHEN regexp_matches(a, '\bcargo\s+test\b') THEN 'cargo' WHEN regexp_matches(a, 'jest|mocha|vitest|npm test|yarn test|pnpm test') THEN 'jest' END AS named FROM k)
SELECT language, coalesce(named, 'unknown') AS named, coalesce(named, CASE lower(language) WHEN 'python' THEN 'pytest' WHEN 'go' THEN 'go' WHEN 'rust' THEN 'cargo' WHEN 'node' THEN 'jest' ELSE 'unknown' END) AS runner, count(*) AS n FROM n GROUP BY 1, 2, 3""",
    "q_e09_skip_hist": f"WITH {_SEQ} SELECT coalesce(reason, 'emitted') AS reason, count(*) AS n FROM seq GROUP BY 1",
    "q_c15_commit_reasons": f"WITH {_CM} SELECT number, coalesce(basic, CASE WHEN NOT fixes THEN 'not_a_bugfix' END, CASE WHEN said < 30 THEN 'problem_statement_too_short' END) AS reason FROM meta",
    "q_c19_path_class": f"WITH {_PATH} SELECT * FROM cls",
    "q_s06_diff_split": f"WITH {_PATH}, f AS (SELECT l_orderkey AS id, l_linenumber, is_test FROM lineitem JOIN cls ON cls.id = l_partkey), g AS (SELECT id, count(*) FILTER (NOT is_test) AS n_source, count(*) FILTER (is_test) AS n_test, count(*) FILTER (is_test) AS new_tests, count(*) * 3 AS loc FROM f GROUP BY 1) SELECT *, CASE WHEN n_source = 0 THEN 'empty_source_patch' WHEN n_test = 0 THEN 'no_test_patch' WHEN n_source > 10 THEN 'too_many_source_files' END AS reason FROM g",
    "q_c34_audit": f"WITH {_AUDIT} SELECT * FROM a",
    "q_e08_audit_hist": f'WITH {_AUDIT} SELECT "check", count(*) AS n FROM a WHERE NOT ok GROUP BY 1',
    "q_c36_difficulty": "SELECT CASE WHEN l_quantity * 2 <= 5 AND l_linenumber <= 1 THEN 'trivial' WHEN l_quantity * 2 <= 20 THEN 'small' WHEN l_quantity * 2 <= 80 THEN 'medium' ELSE 'large' END AS difficulty, count(*) AS n FROM lineitem GROUP BY 1",
    "q_s19_repo_slug": "SELECT c_custkey, concat(CASE c_custkey % 5 WHEN 0 THEN 'Own' ELSE 'own' END, '/r', c_custkey) AS slug FROM customer",
}
SQL = {name: oracle(text) for name, text in SQL.items()}
