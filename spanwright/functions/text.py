"""Text, path and diff expressions for mining tasks from repositories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path parts that make a test or a documentation file.
TEST_DIRS = ("test", "tests", "testing", "e2e", "__tests__")
DOC_ROOTS = ("docs", "doc", "documentation", "examples", "example")
#: Patterns of references that point at a solution, removed in this order.
LEAKS = (
    r"(?i)\b(?:cherry[-\s]?pick(?:ed|ing|s)?|back[-\s]?port(?:ed|ing|s)?|commit)\b[^\n]*?\b[0-9a-f]{7,40}\b",
    r"\b[0-9a-f]{40}\b",
    r"\[[^\]]*\]\(https?://github\.com/[^\s)]*?/(?:pull|issues|commit)/[^\s)]*\)",
    r"https?://(?:\w+\.)?github\.com/[^\s)]*?/(?:pull|issues|commit)/\S+",
    r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?|see|refs?|ref|follow[-\s]?up(?:\s+to)?)\b[:\s]*(?:[\w.-]+/[\w.-]+)?#\d+",
    r"\[#\d+\]\([^)]*\)",
    r"\s*\(#\d+\)",
    r"\b[a-z][a-z0-9._-]{2,}#\d+\b",
)
#: Fixed value: headers after which a description holds no problem statement.
NOISE_HEADER = r"(?i)^\s*#{0,6}\s*(?:checklist|change\s*log|changelog|release\s*notes?|how\s+to\s+test|test\s*plan|tests?\s+added(?:\s*/?\s*updated)?|tests?\s+added\s+or\s+updated|testing|types?\s+of\s+changes?|pr\s+checklist|reviewer\s+notes?)\s*:?\s*$"
#: Comments of descriptions, links that close an issue, and the longest body that is shown.
COMMENT = r"(?s)<!--.*?-->"
LINK = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+(?:\[?#(\d+)|https?://(?:\w+\.)?github\.com/([\w.-]+)/([\w.-]+)/issues/(\d+))"
BODY_LIMIT = 4000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b"))


def without_comments(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), COMMENT, "")


def strip_info_leak(text: Column) -> Column:
    for pattern in LEAKS:
        text = F.regexp_replace(text, pattern, "")
    return text


def linked_issue(body: Column, repo: Column) -> Column:
    """Number of the first issue of the own repository (``owner/name``) that a body closes; null for none."""
    text = without_comments(body)
    groups = lambda k: F.regexp_extract_all(text, F.lit(LINK), F.lit(k))
    links = F.arrays_zip(groups(1).alias("h"), groups(2).alias("o"), groups(3).alias("n"), groups(4).alias("u"))
    own = F.filter(links, lambda x: (x["h"] != "") | (F.lower(F.concat_ws("/", x["o"], x["n"])) == F.lower(repo)))
    first = F.try_element_at(own, F.lit(1))
    return F.coalesce(F.nullif(first["h"], F.lit("")), F.nullif(first["u"], F.lit(""))).cast("int")


def reflowed(body: Column) -> Column:
    """A body without comments and template sections, blank runs collapsed, cut at the limit."""
    lines = F.split(without_comments(body), r"\r\n|\n|\r")
    noise = F.array_position(F.transform(lines, lambda x: x.rlike(NOISE_HEADER)), F.lit(True))
    kept = F.when(noise > 0, F.slice(lines, F.lit(1), (noise - 1).cast("int"))).otherwise(lines)
    text = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(text) > BODY_LIMIT, F.concat(F.regexp_replace(F.left(text, F.lit(BODY_LIMIT)), r"(?U)\s+$", ""), F.lit("\n\n…(truncated)"))).otherwise(text)


def is_test_path(path: Column) -> Column:
    """A test file by directory or by its runner's naming; nothing under a documentation root is one."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: p != "")
    n = F.size(parts)
    base = F.try_element_at(parts, F.lit(-1))
    folders = F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))
    named = base.rlike(r"^conftest\.py$|^test_.*\.(?:py|js|ts)$|_test\.(?:py|go)$|\.(?:test|spec)\.(?:ts|js)$")
    return F.coalesce((n > 0) & ~F.try_element_at(parts, F.lit(1)).isin(*DOC_ROOTS) & (F.exists(folders, lambda p: p.isin(*TEST_DIRS)) | named), F.lit(False))


def diff_blocks(diff: Column) -> Column:
    """Blocks of a unified diff, one per file."""
    return F.filter(F.split(diff, r"(?m)(?=^diff --git )"), lambda b: b.startswith("diff --git "))


def unquoted_path(path: Column) -> Column:
    """A path without the C-style escapes of its bytes (``na\\303\\257ve`` becomes ``naïve``); as it is if they make no text."""
    parts = F.regexp_extract_all(path, F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))
    byte = lambda p: F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0")
    plain = F.create_map(*(F.lit(x) for pair in ((r"\n", "0A"), (r"\t", "09"), (r"\r", "0D"), (r"\"", "22"), (r"\\", "5C")) for x in pair))
    one = lambda p: F.when(p.rlike(r"^\\[0-7]{3}$"), byte(p)).when(p.startswith("\\"), F.coalesce(F.try_element_at(plain, p), F.hex(F.substring(p, 2, 1)))).otherwise(F.hex(p))
    raw = F.unhex(F.array_join(F.transform(parts, one), ""))
    return F.when(F.contains(path, F.lit("\\")) & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(path)


def diff_path(block: Column, side: str) -> Column:
    """Path of side ``a`` or ``b`` of a block's header, without quotes and escapes."""
    # git's header of a file, quoted where a name needs escapes
    header = r'(?m)\Adiff --git (?:"a/((?:[^"\\]|\\.)+)"|a/(.+?)) (?:"b/((?:[^"\\]|\\.)+)"|b/(.+?))$'
    quoted, plain = (1, 2) if side == "a" else (3, 4)
    return F.coalesce(unquoted_path(F.nullif(F.regexp_extract(block, header, quoted), F.lit(""))), F.nullif(F.regexp_extract(block, header, plain), F.lit("")))


def changed_lines(diff: Column) -> Column:
    return F.size(F.filter(F.split(diff, "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(?:\+\+\+|---) ")))


#: Fixed value: lines that add a test.
NEW_TEST = r"^\+\s*(?:def\s+test_\w+|class\s+\w*[Tt]est\w*|func\s+Test\w+|it\s*\(|test\s*\(|describe\s*\()"


def new_test_functions(diff: Column) -> Column:
    return F.size(F.filter(F.split(diff, "\n"), lambda x: x.rlike(NEW_TEST)))


def redacted(url: Column) -> Column:
    """An address without credentials."""
    return F.regexp_replace(url, r"(?i)(\w+://)[^/@\s]+@", "$1***@")


def repo_slug(url: Column) -> Column:
    """``owner/name`` of a repository's address in any of its spellings."""
    path = F.regexp_replace(F.trim(url), r"(?i)^(?:git\+)?(?:https?://|ssh://git@|git@|git://)?(?:www\.)?github\.com[/:]|^github:", "")
    parts = F.split(F.regexp_replace(path, r"[?#].*$", ""), "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", parts[0], F.regexp_replace(parts[1], r"\.git$", "")))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
