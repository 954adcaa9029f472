"""The library's expressions as SQL functions of a session."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

FUNCTIONS = {
    "pass_at_k(n INT, c INT, k INT)": (
        "DOUBLE",
        "CASE WHEN n <= 0 OR k <= 0 OR k > n THEN NULL WHEN n - c < k THEN 1D "
        "ELSE 1D - aggregate(sequence(0, greatest(k - 1, 0)), 1D, (acc, i) -> acc * (n - c - i) / (n - i)) END",
    ),
    "safe_rate(part DOUBLE, whole DOUBLE)": ("DOUBLE", "try_divide(part, whole)"),
    "mcnemar_exact_p(b INT, c INT)": (
        "DOUBLE",
        "CASE WHEN b + c > 0 THEN least(1D, 2D * aggregate(sequence(0, least(b, c)), named_struct('term', pow(0.5D, b + c), 'sum', 0D), "
        "(acc, i) -> named_struct('term', acc.term * (b + c - i) / (i + 1), 'sum', acc.sum + acc.term), acc -> acc.sum)) END",
    ),
    "strip_trailing_ref(title STRING)": ("STRING", r"regexp_replace(title, '\\s*\\(#\\d+\\)', '')"),
    "is_majority(passed INT, n INT)": ("BOOLEAN", "passed * 2 > n"),
}


@udtf(returnType="test string, status string")
class ParseTestLog:
    """Rows (test, status) of verbose pytest output, the last line of a test holding."""

    def eval(self, log: str) -> Iterator[tuple[str, str]]:
        last: dict[str, str] = {}
        for line in (log or "").split("\n"):
            m = re.match(r"(\S+(?:::\S+|\.py))\s+(PASSED|FAILED|SKIPPED|ERROR)\b", line.strip())
            if m:
                last[m[1]] = m[2]
        yield from last.items()


@udtf(returnType="pos int, path string, block string")
class SplitDiff:
    """Rows (pos, path, block) of a unified diff, one per file."""

    def eval(self, diff: str) -> Iterator[tuple[int, str, str]]:
        blocks = [b for b in re.split(r"(?m)^(?=diff --git )", diff or "") if b.startswith("diff --git ")]
        for pos, block in enumerate(blocks):
            head = block.split("\n", 1)[0]
            yield pos, head.rsplit(" b/", 1)[-1] if " b/" in head else head.rsplit(' "b/', 1)[-1].rstrip('"'), block


def register(spark: SparkSession) -> None:
    """Install all functions in a session; calling it again replaces them."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("parse_test_log", ParseTestLog)
    spark.udtf.register("split_diff", SplitDiff)
