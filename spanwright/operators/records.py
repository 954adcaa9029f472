"""Small record operators: replays, grounding, gates, identifiers, byte tails, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.stats import rate

#: Files that mark a language, in order of preference.
MARKERS = (
    ("rust", ("Cargo.toml",)),
    ("go", ("go.mod",)),
    ("node", ("package.json", "tsconfig.json", "pnpm-lock.yaml", "yarn.lock")),
    ("python", ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt")),
    ("java", ("pom.xml", "build.gradle", "build.gradle.kts")),
    ("c_cpp", ("CMakeLists.txt", "configure.ac", "Makefile", "meson.build")),
)


def desync_stats(trials: DataFrame) -> DataFrame:
    """One row over replays (verified, consistent, unsupported ARRAY): a rate over those that were checked only."""
    verified = F.col("verified")
    return trials.agg(
        F.count("*").alias("n"), F.count_if(verified).alias("verified"), F.count_if(verified & ~F.col("consistent")).alias("desynced"), F.count_if(F.size("unsupported") > 0).alias("blocked")
    ).select("*", F.coalesce(rate(F.col("desynced"), F.col("verified")), F.lit(0.0)).alias("desync_rate"), F.coalesce(rate(F.col("n") - F.col("verified"), F.col("n")), F.lit(0.0)).alias("unverified_rate"))


def grounding(pairs: DataFrame, min_gap: float, floor: float = 0.70) -> DataFrame:
    """One row over (label_agrees, gap): agreement, blur of the disagreements, and a threshold that only ever rises."""
    seen, wrong = F.col("label_agrees").isNotNull(), ~F.col("label_agrees")
    stats = pairs.agg(F.count("*").alias("n"), F.count_if(seen).alias("judged"), F.avg(F.when(seen, F.col("label_agrees").cast("double"))).alias("agreement"), F.coalesce(F.avg(F.when(wrong, F.abs("gap"))), F.lit(0.0)).alias("blur"))
    raised = F.when((F.col("agreement") < floor) & (F.col("blur") > min_gap), F.col("blur")).otherwise(F.lit(min_gap))
    return stats.select("*", raised.alias("suggested_min_gap"), (F.col("judged") < 10).alias("underpowered"))


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key: what a loop that never overwrites keeps."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("k = 1").drop("k")


def conflicting_keys(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """Keys under which different values were stored."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("values")).where("values > 1")


def node_symbol(node: Column) -> Column:
    """A test's own name: the last part of its id, without parameters or subtests."""
    parts = F.filter(F.split(F.trim(node), r"::|[#>.]"), lambda p: p != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.trim(F.split_part(F.split_part(last, F.lit("["), F.lit(1)), F.lit("/"), F.lit(1)))


def language_of(names: Column) -> Column:
    """The language whose marker file is at hand, by the markers' order."""
    found = (F.when(F.arrays_overlap(names, F.array(*(F.lit(f) for f in files))), language) for language, files in MARKERS)
    return F.coalesce(*found, F.lit("unknown"))


def attempt_of(name: Column) -> Column:
    """(task, attempt) of a trial's name ``task-N``."""
    shape = r"^(.+)-(\d+)$"
    return F.struct(F.coalesce(F.nullif(F.regexp_extract(name, shape, 1), F.lit("")), name).alias("task"), F.nullif(F.regexp_extract(name, shape, 2), F.lit("")).try_cast("int").alias("attempt"))


def between_marks(text: Column, start: str, end: str) -> Column:
    """What stands between two marks; all of it if the first is missing, the rest if the second is."""
    after = F.when(F.contains(text, F.lit(start)), F.substring_index(text, start, -1)).otherwise(text)
    return F.when(F.contains(after, F.lit(end)), F.substring_index(after, end, 1)).otherwise(after)


def normalised_diff(diff: Column) -> Column:
    """A diff without blank lines and without the headers that depend on the repository's state."""
    return F.array_join(F.filter(F.split(diff, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("index ") & ~x.startswith("diff --git ")), "\n")


def decoded_tail(raw: Column) -> Column:
    """Text of bytes whose last character may be cut off: at most three bytes are left out; null if more are bad."""
    candidates = [F.substring(raw, F.lit(1), F.octet_length(raw) - k) for k in range(4)]
    return F.coalesce(*(F.when(F.is_valid_utf8(c.cast("string")) & (F.octet_length(raw) >= k), c.cast("string")) for k, c in enumerate(candidates)))


def joined_or_null(parts: Column) -> Column:
    """Parts joined; null if any is missing."""
    return F.when(F.forall(parts, lambda p: p.isNotNull()), F.array_join(parts, ""))


def run_of_ids(got: Column, wanted: Column) -> Column:
    """Start (from 0) of the only place where ``wanted`` occurs in ``got``; null if there is none or there are several."""
    last = F.size(got) - F.size(wanted) + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda s: F.slice(got, s, F.size(wanted)) == wanted)
    return F.when(F.size(hits) == 1, hits[0] - 1)


def without_trailing(ids: Column, special: Column) -> Column:
    """Ids without the special ones at the end."""
    plain = F.transform(ids, lambda i: ~F.array_contains(special, i))
    last = F.size(ids) - F.array_position(F.reverse(plain), F.lit(True)).cast("int") + 1
    return F.when(F.array_contains(plain, F.lit(True)), F.slice(ids, F.lit(1), last)).otherwise(F.slice(ids, 1, 0))


def epoch_order(rows: DataFrame, key: str, epochs: int, seed: int) -> DataFrame:
    """Each row once an epoch, reshuffled by a hash of key, epoch and seed.

    The order is that of the hash, so the rows are cut by its first digits into 4,096 parts an epoch; a row's place is
    its rank within its part after the sizes of the parts before.
    """
    each = rows.select(F.col(key), F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).withColumn("hash", F.md5(F.concat_ws(":", key, "epoch", F.lit(seed))))
    placed = each.withColumn("part", F.left("hash", F.lit(3)))
    ahead = Window.partitionBy("epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("epoch", "part").agg(F.count("*").alias("n")).select("epoch", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("epoch", "part").orderBy("hash", key)) - 1
    return placed.withColumn("rank", rank).join(sizes, ["epoch", "part"]).select(key, "epoch", (F.col("before") + F.col("rank")).cast("int").alias("at"))


def mean_of_means(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean over groups of each group's mean: every sequence weighs the same."""
    return rows.groupBy(group).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"), F.count("*").alias("groups"))


def ratio_summary(rows: DataFrame, key: str, ratio: Column, ceiling: float) -> DataFrame:
    """Least, median and largest ratio, how many exceed the ceiling, and the row with the largest."""
    r = rows.select(F.col(key), ratio.alias("r"))
    return r.agg(F.min("r").alias("least"), F.median("r").alias("median"), F.max("r").alias("most"), F.count_if(F.col("r") > ceiling).alias("over"), F.max_by(key, F.struct("r", key)).alias("argmax"))
