"""Choosing pull requests and commits that make tasks, and auditing the tasks made."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import changed_lines, diff_blocks, diff_path, is_test_path, linked_issue, new_test_functions, reflowed, strip_info_leak, word_count
from spanwright.operators.records import node_symbol

#: Fixed value: titles of housekeeping rather than fixes.
NON_BUG_TITLE = (
    r"(?i)\b(?:back[-\s]?port|cherry[-\s]?pick|revert|bump|release|changelog|forward[-\s]?merge|prepare\s+(?:for\s+)?release|version\s+bump|re-?sync)\b"
    r"|\bmerge\b[^\n]*\binto\b|\bmerge\s+(?:branch|stable|main|master|develop|upstream|release)\b|\bsync\s+(?:stable|main|master|branch|develop|upstream)\b"
)
#: Fixed value: conventional types of commits that are no fixes.
NON_BUG_TYPE = r"(?i)^(?:chore|docs|feat|refactor|style|test|ci|build|perf|revert)(?:\([^)]+\))?!?:"
#: Fixed value: the type that a commit's subject begins with.
COMMIT_TYPE = r"(?i)^(?:fix|feat|chore|docs|refactor|test|perf|build|ci|style|revert)(?:\([^)]+\))?!?:\s*"
#: What shows that a commit fixes a bug.
FIX_TYPE = r"(?i)^fix(?:\([^)]+\))?!?:"
CLOSES = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+\[?#\d+"
BUGFIX_WORD = (
    r"(?i)\b(?:fix(?:e[sd])?|fixing|bug(?:fix|s)?|regression|crash(?:e[sd]|ing)?|broken|incorrect(?:ly)?|wrong(?:ly)?|fail(?:s|ed|ing|ure)?|defect|hotfix|"
    r"raise[sd]?|error|exception|traceback|leak|deadlock|race)\b"
)
#: Fixed value: definitions that a patch introduces.
DEFINED = r"(?m)^\+\s*(?:def|class|func|fn|type|struct|interface)\s+([A-Za-z_]\w*)"
#: Fixed value: extensions by which the id of a test names its file.
TEST_EXTENSIONS = ("py", "js", "jsx", "ts", "tsx", "go", "rs", "java", "kt", "scala", "rb", "php", "cs", "c", "cc", "cpp")
#: Steps that remove a repository's future, in a build file.
SCRUBS = ("git remote remove origin", "git branch -D", "git tag -d", "git reflog expire", "git gc --prune=now")
#: Fixed value: parts of names and addresses of bots.
BOTS = ("dependabot", "renovate", "pre-commit-ci")


def is_non_bug(title: Column) -> Column:
    return F.coalesce(title.rlike(NON_BUG_TITLE), F.lit(False))


def pr_reason(repo: Column, min_words: int = 0) -> Column:
    """Why a pull request is skipped before its diff is read; null to keep it."""
    return (
        F.when(F.col("is_draft"), "draft")
        .when(F.col("merged_at").isNull() | (F.col("merged_at") == ""), "not_merged")
        .when(F.coalesce(F.size("changed_files"), F.lit(0)) <= 0, "no_files")
        .when(is_non_bug(F.col("title")), "non_bug_pr")
        .when(linked_issue(F.col("body"), repo).isNull(), "no_linked_issue")
        .when(F.lit(min_words) > word_count(F.coalesce("body", F.lit(""))), "problem_statement_too_short")
    )


def commit_reason(min_words: int = 5, min_problem_words: int = 0, bugfix_only: bool = False) -> Column:
    """Why a commit (parents, author_name, author_email, subject, body) is skipped by its message alone; null to keep it.

    ``bugfix_only`` asks for a sign of a fix: its type, a closed issue, or a word in the subject.
    """
    author = F.lower(F.concat_ws(" ", "author_name", "author_email"))
    bot = F.exists(F.array(*(F.lit(b) for b in BOTS)), lambda b: F.contains(author, b))
    message, subject = F.concat_ws("\n", "subject", "body"), F.coalesce("subject", F.lit(""))
    fixes = subject.rlike(FIX_TYPE) | message.rlike(CLOSES) | subject.rlike(BUGFIX_WORD)
    return (
        F.when(F.size("parents") > 1, "merge_commit")
        .when(F.coalesce(F.size("parents"), F.lit(0)) <= 0, "root_commit")
        .when(bot, "excluded_author")
        .when(word_count(message) < min_words, "message_too_short")
        .when(subject.rlike(NON_BUG_TYPE), "non_bug_type")
        .when(F.lit(bugfix_only) & ~fixes, "not_a_bugfix")
        .when(F.lit(min_problem_words) > word_count(message), "problem_statement_too_short")
    )


def lite_reason(body: Column, n_source: Column, max_files: int = 50, light: bool = True) -> Column:
    """Why a pull request touches too much, or is too much for a light task; null to keep it."""
    # fixed values: the names and patterns of the rules
    low = F.lower(F.coalesce(body, F.lit("")))
    asked = F.lit(light)
    return (
        F.when(n_source > max_files, "too_many_source_files")
        .when(asked & (n_source != 1), "lite_not_single_source_file")
        .when(asked & (word_count(low) < 40), "lite_problem_too_short")
        .when(asked & low.rlike(r"!\[[^\]]*\]\(|<img\s"), "lite_has_image")
        .when(asked & low.rlike(r"\bhttps?://(?!github\.com/)"), "lite_has_external_link")
        .when(asked & low.rlike(r"\b[a-f0-9]{7,40}\b"), "lite_has_commit_sha")
    )


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that later expressions share; a plain projection would be copied into each of them."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def with_diff_facts(rows: DataFrame) -> DataFrame:
    """``rows`` (diff, ...) with what the sequences ask of a diff as one struct ``facts``; no file leaves the row of its diff.

    ``source`` and ``test`` are the paths of its files, ``new_tests`` the tests that it adds, ``defined`` the names it
    introduces. A file belongs to the tests if either of its paths does.
    """
    blocks = F.transform(diff_blocks(F.coalesce("diff", F.lit(""))), lambda b: F.struct(diff_path(b, "a").alias("a"), diff_path(b, "b").alias("b"), b.alias("block")))
    sided = F.transform(F.col("__files"), lambda f: F.struct(f["b"].alias("path"), (is_test_path(f["a"]) | is_test_path(f["b"])).alias("test"), f["block"].alias("block")))
    files = F.col("__sided")
    paths = lambda wanted: F.array_distinct(F.transform(F.filter(files, lambda f: f["test"] == wanted), lambda f: f["path"]))
    facts = F.struct(
        paths(False).alias("source"),
        paths(True).alias("test"),
        F.aggregate(F.filter(files, lambda f: f["test"]), F.lit(0), lambda n, f: n + new_test_functions(f["block"])).alias("new_tests"),
        F.array_distinct(F.regexp_extract_all(F.coalesce("diff", F.lit("")), F.lit(DEFINED), F.lit(1))).alias("defined"),
    )
    read = computed_once(computed_once(rows, "__files", blocks), "__sided", sided).drop("__files")
    return computed_once(read, "facts", facts).drop("__sided")


def _structure(facts: Column) -> dict[str, Column]:
    source, test = F.size(facts["source"]), F.size(facts["test"])
    return {
        "empty_source_patch": source <= 0,
        "no_test_patch": test <= 0,
        "ci_only_patch": F.forall(facts["source"], lambda p: p.startswith(".github/")),
        "no_new_test_funcs": facts["new_tests"] < 1,
    }


def _first(*reasons: Column) -> Column:
    return F.coalesce(*reasons)


def pr_sequence(prs: DataFrame, repo: Column, min_words: int = 0, max_files: int = 50, light: bool = False, min_fail_to_pass: int = 1) -> DataFrame:
    """``prs`` with ``reason``: why a pull request makes no task, by the first step that says so; null if it is emitted.

    Its columns, then its ``diff``, the lite rules and the number of tests that its fix turns (``n_fail_to_pass``, null
    where validation was skipped). One projection: nothing is exchanged.
    """
    read = with_diff_facts(prs)
    steps = [F.when(v, k) for k, v in _structure(F.col("facts")).items()]
    turned = F.when(F.col("n_fail_to_pass") < min_fail_to_pass, "no_fail_to_pass")
    return read.withColumn("reason", _first(pr_reason(repo, min_words), *steps, lite_reason(F.col("body"), F.size("facts.source"), max_files, light), turned)).drop("facts")


def commit_instruction(subject: Column, body: Column) -> Column:
    """What a task tells of a commit: its message without its type, template sections and references to the fix."""
    title = F.regexp_replace(F.coalesce(subject, F.lit("")), COMMIT_TYPE, "")
    return F.concat(F.lit("# Issue\n\n"), strip_info_leak(title), F.lit("\n\n"), strip_info_leak(reflowed(body)))


def _code_shaped(name: Column) -> Column:
    return (F.length(name) >= 5) & (name.contains("_") | name.rlike("[a-z][A-Z]"))


def leaked_names(instruction: Column, facts: Column) -> Column:
    """Code-shaped names that a diff introduces, or stems of its files, that an instruction uses as words; sorted."""
    stems = F.transform(F.concat(facts["source"], facts["test"]), lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"(?<=.)\.[^.]*$", ""))
    names = F.filter(F.array_distinct(F.concat(facts["defined"], stems)), _code_shaped)
    words = F.array_distinct(F.regexp_extract_all(instruction, F.lit(r"(?U)\w+"), F.lit(0)))
    # a stem may hold marks that part words; it is looked for as it stands
    plain, marked = F.filter(names, lambda n: ~n.rlike(r"\W")), F.filter(names, lambda n: n.rlike(r"\W"))
    whole = F.filter(marked, lambda n: F.regexp_like(instruction, F.concat(F.lit(r"(?U)\b\Q"), n, F.lit(r"\E\b"))))
    return F.array_sort(F.concat(F.array_intersect(plain, words), whole))


def commit_sequence(commits: DataFrame, min_words: int = 5, min_problem_words: int = 0, bugfix_only: bool = False, max_files: int = 10, min_fail_to_pass: int = 1) -> DataFrame:
    """``commits`` with ``reason`` (null if emitted), the ``instruction`` and the names it would leak.

    The message, then the ``diff``, the number of tests that the commit turns, and last whether its instruction names
    the fix.
    """
    read = computed_once(with_diff_facts(commits), "instruction", commit_instruction(F.col("subject"), F.col("body")))
    s = _structure(F.col("facts"))
    steps = [F.when(s[k], k) for k in ("empty_source_patch", "no_test_patch", "ci_only_patch")]
    steps += [F.when(F.size("facts.source") > max_files, "too_many_source_files"), F.when(s["no_new_test_funcs"], "no_new_test_funcs")]
    named = computed_once(read, "leaked", leaked_names(F.col("instruction"), F.col("facts")))
    turned = F.when(F.col("n_fail_to_pass") < min_fail_to_pass, "no_fail_to_pass")
    reason = _first(commit_reason(min_words, min_problem_words, bugfix_only), *steps, turned, F.when(F.size("leaked") > 0, "instruction_leaked"))
    return named.withColumn("reason", reason).drop("facts")


def diff_files(diffs: DataFrame) -> DataFrame:
    """One row per file of each diff (id, diff): (id, pos, path_a, path_b, is_test, block)."""
    blocks = diffs.select("id", F.posexplode(diff_blocks(F.col("diff"))).alias("pos", "block"))
    a, b = diff_path(F.col("block"), "a"), diff_path(F.col("block"), "b")
    return blocks.select("id", "pos", a.alias("path_a"), b.alias("path_b"), (is_test_path(a) | is_test_path(b)).alias("is_test"), "block")


def structural_reasons(files: DataFrame, max_files: int = 10) -> DataFrame:
    """Per diff the first structural reason to skip it: no source, no tests, only CI, too many files, no new tests."""
    source = ~F.col("is_test")
    facts = files.groupBy("id").agg(
        F.count_if(source).alias("n_source"), F.count_if("is_test").alias("n_test"), F.count_if(source & F.col("path_b").startswith(".github/")).alias("n_ci"),
        F.sum(F.when(F.col("is_test"), new_test_functions(F.col("block"))).otherwise(0)).alias("new_tests"), F.sum(changed_lines(F.col("block"))).alias("loc"),
    )
    reason = (
        F.when(F.col("n_source") == 0, "empty_source_patch")
        .when(F.col("n_test") == 0, "no_test_patch")
        .when(F.col("n_ci") == F.col("n_source"), "ci_only_patch")
        .when(F.col("n_source") > max_files, "too_many_source_files")
        .when(F.col("new_tests") < 1, "no_new_test_funcs")
    )
    return facts.withColumn("reason", reason)


def difficulty(loc: Column, f2p: Column) -> Column:
    return F.when((loc <= 5) & (f2p <= 1), "trivial").when(loc <= 20, "small").when(loc <= 80, "medium").otherwise("large")


def skip_histogram(rows: DataFrame) -> DataFrame:
    """How many were skipped for each reason, and how many were kept."""
    return rows.groupBy(F.coalesce("reason", F.lit("emitted")).alias("reason")).agg(F.count("*").alias("n"))


def leaked_identifiers(instructions: DataFrame, diffs: DataFrame) -> DataFrame:
    """Code-shaped names that a task's diff introduces and its instruction uses: (id, name)."""
    both = instructions.select("id", "instruction").join(diffs.select("id", "diff"), "id")
    return with_diff_facts(both).select("id", F.explode(leaked_names(F.col("instruction"), F.col("facts"))).alias("name"))


def parsed_task_files(tasks: DataFrame) -> DataFrame:
    """``tasks`` (task, task_toml, ...) with what their descriptions declare: whether they parse, base commit, fail-to-pass ids.

    No built-in reads TOML, so it is parsed in Arrow batches; a malformed one is a finding, not an error.
    """
    kept = [c for c in tasks.columns if c != "task_toml"]
    at = len(kept)

    def declared(text: str | None) -> tuple[bool | None, bool, str, list[str]]:
        if text is None:
            return None, False, "", []
        try:
            found = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return False, False, "", []
        table = lambda d, k: d.get(k) if isinstance(d, dict) and isinstance(d.get(k), dict) else {}
        named = table(table(found, "metadata"), "repo2env")
        own = table(named, "pr_runtime") or table(named, "commit_runtime")
        base, ids = own.get("base_commit", ""), own.get("fail_to_pass")
        formed = bool(own) or not isinstance(found.get("metadata"), dict)
        return True, formed, base if isinstance(base, str) else "", [x for x in ids if isinstance(x, str)] if isinstance(ids, list) else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [declared(t) for t in batch.column(at).to_pylist()]
            kinds = [pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.string())]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.record_batch([*batch.columns[:at], *made], names=[*kept, "parses", "formed", "base_commit", "fail_to_pass"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.select(*kept).schema)
    return tasks.select(*kept, "task_toml").mapInArrow(work, f"{fields}, parses boolean, formed boolean, base_commit string, fail_to_pass array<string>")


def task_audit(tasks: DataFrame) -> DataFrame:
    """One row per task (task, task_toml, dockerfile, test_sh, oracle, f2p_json) and check that applies to it: (task, check, ok).

    A task without a description, or with one that doesn't parse, has that one row. Whether ids name files of the
    test patch is asked only of ids that name files, and names only where ids are declared.
    """
    read = parsed_task_files(tasks)
    text = lambda c: F.coalesce(c, F.lit(""))
    docker, test_sh, oracle, base, ids = text("dockerfile"), text("test_sh"), text("oracle"), F.col("base_commit"), F.col("fail_to_pass")
    scrubbed = F.forall(F.array(*(F.lit(x) for x in SCRUBS)), lambda mark: F.contains(docker, mark))
    cleans = F.regexp_extract_all(docker, F.lit(r"git clean([^\n;&|]*)"), F.lit(1))
    unsafe = F.exists(cleans, lambda c: F.exists(F.split(c, r"\s+"), lambda w: w.rlike("^-[a-zA-Z]*[xX]")))
    targets = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^\+\+\+ b/([^\n]+)$"), F.lit(1)))
    patched = targets(test_sh)
    body = F.array_join(F.filter(F.split(test_sh, "\n"), lambda x: x.rlike("^[-+ ]")), "\n")
    file_of = lambda node: F.regexp_extract(F.trim(node), r"^([^\s:>#]+?\.(?:" + "|".join(TEST_EXTENSIONS) + r"))(?:[:>#]|$)", 1)
    files = F.array_distinct(F.filter(F.transform(ids, file_of), lambda f: f != ""))
    unnamed = F.exists(ids, lambda n: (node_symbol(n) != "") & ~F.contains(body, node_symbol(n)))
    shipped = F.coalesce(F.from_json("f2p_json", "array<string>"), F.array().cast("array<string>"))
    checks = {
        "base_commit_declared": F.length(base) == 40,
        "dockerfile_resets_to_base_commit": (base != "") & docker.contains(F.concat(F.lit("git reset --hard "), base)),
        "git_history_scrubbed": scrubbed,
        "git_clean_preserves_build_artifacts": ~unsafe,
        "dockerfile_installs_tmux": F.exists(F.split(docker, "\n"), lambda x: x.rlike(r"^\s*RUN\b.*\btmux\b")),
        "f2p_declared": F.size(ids) > 0,
        "f2p_files_in_test_patch": F.when(F.size(files) > 0, (F.size(F.array_except(files, patched)) == 0) & (F.size(patched) > 0)),
        "f2p_names_in_test_patch": F.when(F.size(ids) > 0, ~unnamed & (F.trim(body) != "")),
        "shipped_f2p_matches_task_toml": F.array_sort(shipped) == F.array_sort(ids),
        "oracle_patch_present": F.trim(oracle) != "",
        "oracle_excludes_test_files": ~F.arrays_overlap(targets(oracle), patched),
    }
    no = F.lit(None).cast("boolean")
    rows = [
        F.struct(F.lit("task_toml_present").alias("check"), F.when(F.col("parses").isNull(), False).alias("ok")),
        F.struct(F.lit("task_toml_parses").alias("check"), F.when(~F.col("parses"), False).alias("ok")),
        F.struct(F.lit("metadata_well_formed").alias("check"), F.when(F.col("parses") & ~F.col("formed"), False).alias("ok")),
        *(F.struct(F.lit(k).alias("check"), F.when(F.col("parses"), v).otherwise(no).alias("ok")) for k, v in checks.items()),
    ]
    return read.select("task", F.explode(F.array(*rows)).alias("x")).where(F.col("x.ok").isNotNull()).select("task", "x.check", "x.ok")
