"""Test statuses from runner output, and grading against declared tests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASSED, FAILED, SKIPPED, ERROR = "PASSED", "FAILED", "SKIPPED", "ERROR"


def log_lines(logs: DataFrame) -> DataFrame:
    """(log_id, line_no, line) of each log (log_id, log)."""
    return logs.select("log_id", F.posexplode(F.split("log", "\n")).alias("line_no", "line"))


def _last(found: DataFrame) -> DataFrame:
    """The last status written for each test of a log."""
    return found.groupBy("log_id", "test").agg(F.max_by("status", "line_no").alias("status"))


def pytest_status(logs: DataFrame) -> DataFrame:
    """(log_id, test, status) of pytest output, summary lines or verbose ones; the last line wins."""
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    rows = log_lines(logs).select("log_id", "line_no", line.alias("line"))
    leading = F.regexp_extract("line", r"^(PASSED|FAILED|SKIPPED|ERROR)(?: |$)", 1)
    work = F.when((leading == FAILED), F.split_part("line", F.lit(" - "), F.lit(1))).otherwise(F.col("line"))
    tokens = F.filter(F.split(work, r"(?U)\s+"), lambda t: t != "")
    second = F.try_element_at(tokens, F.lit(2))
    bracketed = second.startswith("[") & second.endswith("]")
    summary = F.when(bracketed, F.try_element_at(tokens, F.lit(3))).otherwise(second)
    verbose = r"(?U)^(\S+)\s+(PASSED|FAILED|SKIPPED|ERROR)\b"
    name = F.regexp_extract("line", verbose, 1)
    names_test = name.contains("::") | name.endswith(".py")
    test = F.when(leading != "", summary).when((name != "") & names_test, name)
    status = F.when(leading != "", leading).otherwise(F.regexp_extract("line", verbose, 2))
    return _last(rows.select("log_id", "line_no", test.alias("test"), status.alias("status")).where(F.col("test").isNotNull()))


def _mapped(logs: DataFrame, pattern: str, name_group: int, status_group: int, statuses: dict[str, str]) -> DataFrame:
    status = F.regexp_extract("line", pattern, status_group)
    kind = F.coalesce(*(F.when(status == k, v) for k, v in statuses.items()))
    found = log_lines(logs).select("log_id", "line_no", F.regexp_extract("line", pattern, name_group).alias("test"), kind.alias("status"))
    return _last(found.where(F.col("status").isNotNull()))


# The shapes of lines, here and below, are fixed values: the formats that the runners write.
def go_status(logs: DataFrame) -> DataFrame:
    """Statuses of ``go test -v`` output, subtests included."""
    return _mapped(logs, r"(?U)^\s*---\s+(PASS|FAIL|SKIP):\s+(\S+)", 2, 1, {"PASS": PASSED, "FAIL": FAILED, "SKIP": SKIPPED})


def cargo_status(logs: DataFrame) -> DataFrame:
    """Statuses of ``cargo test`` output."""
    return _mapped(logs, r"(?U)^test\s+(\S+)\s+\.\.\.\s+(ok|FAILED|ignored)\b", 1, 2, {"ok": PASSED, "FAILED": FAILED, "ignored": SKIPPED})


def jest_status(logs: DataFrame) -> DataFrame:
    """Statuses of Jest-like output, named by file, enclosing headers and test.

    Whether a line is a header depends on the last test's indent in its file section only, so it is
    a window. Each section is then read once in order with a stack of its open headers.
    """
    rows = log_lines(logs).select("log_id", "line_no", F.regexp_replace("line", r"(?U)\s+$", "").alias("line")).where(F.col("line") != "")
    order = Window.partitionBy("log_id").orderBy("line_no")
    file = F.regexp_extract("line", r"^(?:PASS|FAIL)\s+(\S+\.(?:ts|tsx|js|jsx|mjs|cjs))\b", 1)
    shape = r"^(\s*)([✓√✕×✗○◯])\s+(.+?)(?:\s+\(\d+(?:\.\d+)?\s*m?s\))?$"
    glyph = F.regexp_extract("line", shape, 2)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    named = rows.select(
        "log_id", "line_no", "line", file.alias("file"), glyph.alias("glyph"),
        (F.length("line") - F.length(F.ltrim("line"))).alias("indent"), F.regexp_replace(F.trim(F.regexp_extract("line", shape, 3)), r"^(?:skipped|todo):\s*", "").alias("name"),
    )
    in_file = named.withColumns({"section": F.count_if(F.col("file") != "").over(so_far), "of": F.last(F.when(F.col("file") != "", F.col("file")), ignorenulls=True).over(so_far)})
    in_section = Window.partitionBy("log_id", "section").orderBy("line_no")
    is_test = (F.col("glyph") != "") & (F.col("file") == "")
    last_indent = F.last(F.when(is_test, F.col("indent")), ignorenulls=True).over(in_section.rowsBetween(Window.unboundedPreceding, -1))
    noise = F.ltrim("line").rlike(r"^(?:Tests:|Test Suites:|Snapshots:|Time:|Ran all|●|→|✗:)")
    header = (F.col("file") == "") & ~is_test & ~noise & F.col("of").isNotNull() & (last_indent.isNull() | (F.col("indent") < last_indent))
    marked = in_file.withColumns({"is_test": is_test, "is_header": F.coalesce(header, F.lit(False))})
    useful = marked.where(F.col("is_header") | F.col("is_test")).select(
        "log_id", "section", "line_no", "is_test", "indent", "of", F.when(F.col("is_test"), F.col("name")).otherwise(F.ltrim("line")).alias("text"), "glyph"
    )
    kind = {f.name: f.dataType.simpleString() for f in useful.schema}["log_id"]
    sections = useful.repartition("log_id", "section").sortWithinPartitions("log_id", "section", "line_no")
    return _last(sections.mapInArrow(_named_tests, f"log_id {kind}, line_no int, test string, status string"))


def _named_tests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tests of sorted sections, each under the headers that are open where it stands: a header closes those indented as much or more."""
    section: tuple | None = None
    open_: list[tuple[int, str]] = []
    status = {"✓": PASSED, "√": PASSED, "○": SKIPPED, "◯": SKIPPED}
    for batch in batches:
        at, rows = [], []
        columns = [batch.column(c).to_pylist() for c in ("log_id", "section", "line_no", "is_test", "indent", "of", "text", "glyph")]
        for i, (log, number, line, is_test, indent, of, text, glyph) in enumerate(zip(*columns)):
            if (log, number) != section:
                section, open_ = (log, number), []
            if not is_test:
                while open_ and open_[-1][0] >= indent:
                    open_.pop()
                open_.append((indent, text))
                continue
            chain = [h for n, h in open_ if n < indent]
            at.append(i)
            rows.append((line, " > ".join([of, *chain, text] if of is not None else [*chain, text]), status.get(glyph, FAILED)))
        if rows:
            lines, tests, found = zip(*rows)
            yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(lines, pa.int32()), pa.array(tests, pa.string()), pa.array(found, pa.string())], names=["log_id", "line_no", "test", "status"])


def runner_of(log: Column) -> Column:
    """The runner that wrote a log, by its marks; null for none."""
    return (
        F.when(log.rlike(r"(?m)^\s*--- (?:PASS|FAIL|SKIP): "), "go")
        .when(log.rlike(r"(?m)^test \S+ \.\.\. (?:ok|FAILED|ignored)"), "cargo")
        .when(log.rlike(r"(?m)^(?:PASS|FAIL)\s+\S+\.(?:ts|tsx|js|jsx|mjs|cjs)"), "jest")
        .when(log.rlike(r"::\S+\s+(?:PASSED|FAILED|SKIPPED|ERROR)|(?m)^(?:PASSED|FAILED|SKIPPED|ERROR) "), "pytest")
    )


#: What names a runner in a test command, in the order asked, and the runner of a language.
RUNNER_MARKS = (("pytest", r"pytest"), ("go", r"\bgo\s+test\b"), ("cargo", r"\bcargo\s+test\b"), ("jest", r"jest|mocha|vitest|npm test|yarn test|pnpm test"))
LANGUAGE_RUNNERS = {"python": "pytest", "go": "go", "rust": "cargo", "node": "jest"}


def runner_of_command(commands: Column, language: Column | None = None) -> Column:
    """The runner that test commands (one text) name, else that of the language, else ``unknown``."""
    low = F.lower(F.coalesce(commands, F.lit("")))
    named = F.coalesce(*(F.when(low.rlike(mark), runner) for runner, mark in RUNNER_MARKS))
    if language is None:
        return F.coalesce(named, F.lit("unknown"))
    by_language = F.coalesce(*(F.when(F.lower(language) == k, v) for k, v in LANGUAGE_RUNNERS.items()))
    return F.coalesce(named, by_language, F.lit("unknown"))


def parsed_logs(logs: DataFrame) -> DataFrame:
    """Statuses of logs (log_id, runner, log), each read by its runner's parser; a log of an unknown runner has none."""
    parsers = {"pytest": pytest_status, "go": go_status, "cargo": cargo_status, "jest": jest_status}
    found = None
    for runner, parse in parsers.items():
        part = parse(logs.where(F.col("runner") == runner).select("log_id", "log"))
        found = part if found is None else found.unionByName(part)
    return found


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """fail_to_pass and pass_to_pass tests of (log_id, test, status) before and after; a test new afterwards is neither."""
    joined = before.withColumnRenamed("status", "pre").join(after.withColumnRenamed("status", "post"), ["log_id", "test"], "left")
    kind = F.when(F.col("pre").isin(FAILED, ERROR) & (F.col("post") == PASSED), "fail_to_pass").when((F.col("pre") == PASSED) & (F.col("post") == PASSED), "pass_to_pass")
    return joined.select("log_id", "test", kind.alias("kind")).where(F.col("kind").isNotNull())


def grades(declared: DataFrame, statuses: DataFrame) -> DataFrame:
    """Reward and resolution per log of declared (log_id, test, kind) tests; a test missing from the log hasn't passed.

    ``untracked`` counts failed tests of the log that aren't declared.
    """
    d = declared.select("log_id", "test", "kind")
    both = d.join(statuses, ["log_id", "test"], "full")
    f2p, p2p, ok = F.col("kind") == "fail_to_pass", F.col("kind") == "pass_to_pass", F.coalesce(F.col("status") == PASSED, F.lit(False))
    counted = both.groupBy("log_id").agg(
        F.count_if(f2p).alias("f2p_total"), F.count_if(f2p & ok).alias("f2p_passed"), F.count_if(p2p).alias("p2p_total"), F.count_if(p2p & ok).alias("p2p_passed"),
        F.count_if(F.col("kind").isNull() & (F.col("status") == FAILED)).alias("untracked"),
    )
    f_rate = F.coalesce(F.try_divide(F.col("f2p_passed"), F.col("f2p_total")), F.lit(0.0))
    p_rate = F.coalesce(F.try_divide(F.col("p2p_passed"), F.col("p2p_total")), F.lit(1.0))
    resolved = (F.col("f2p_total") > 0) & (F.col("f2p_passed") == F.col("f2p_total")) & (F.col("p2p_passed") == F.col("p2p_total"))
    return counted.select("*", F.bround(f_rate, 6).alias("f2p_rate"), F.bround(p_rate, 6).alias("p2p_rate"), F.bround(f_rate * p_rate, 6).alias("reward"), resolved.alias("resolved"))
