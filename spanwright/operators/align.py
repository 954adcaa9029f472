"""Byte-exact alignment of two token streams and the statistics that a divergence loss needs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.stats import log_sum_exp

MAX_SPAN = 8
COVERAGE, FLOOR = 0.9, 1e-3


def content_type(raw: Column) -> Column:
    """empty, binary, whitespace, numeric, identifier or other, by the bytes of a span."""
    text = F.when(F.is_valid_utf8(raw), raw.cast("string"))
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return (
        F.when(F.octet_length(raw) == 0, "empty")
        .when(text.isNull(), "binary")
        .when(bare == "", "whitespace")
        .when(bare.rlike(r"^[\p{Nd}.\-+eE]+$") & bare.rlike(r"\p{Nd}"), "numeric")
        .when(bare.rlike(r"^[\p{L}\p{N}_/.\-$@:]+$") & bare.rlike(r"\p{L}"), "identifier")
        .otherwise("other")
    )


def _slim(tokens: DataFrame, *keep: str) -> DataFrame:
    """Tokens by the sizes of their bytes, so that an exchange moves no bytes."""
    return tokens.select("ex_id", "side", "idx", F.octet_length("token").cast("bigint").alias("size"), *keep).repartition("ex_id")


def byte_ends(tokens: DataFrame) -> DataFrame:
    """Tokens (ex_id, side, idx, token BINARY) with the byte offset at which each ends, and which of several ends there it is."""
    stream = Window.partitionBy("ex_id", "side").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("size") if "size" in tokens.columns else F.octet_length("token").cast("bigint")
    ended = tokens.withColumns({"byte_end": F.sum(size).over(stream), "zeros": F.sum((size == 0).cast("int")).over(stream), "size": size})
    # tokens without bytes share their end with the token before; counting them needs no second sort
    base = F.max(F.when(F.col("size") > 0, F.col("zeros"))).over(stream)
    return ended.withColumn("occurrence", F.coalesce(F.col("zeros") - base + 1, F.col("zeros")).cast("int")).drop("zeros", "size")


def aligned_spans(tokens: DataFrame) -> DataFrame:
    """Spans over which both streams cover the same bytes, in order.

    Greedy merging of two streams meets exactly where both have a token with the same end and
    occurrence number, so it is an equi-join; here a grouping, which needs no second copy of the
    tokens. All steps share one exchange by ``ex_id``.
    """
    ends = byte_ends(_slim(tokens))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("idx")))
    met = ends.groupBy("ex_id", "byte_end", "occurrence").agg(of("student").alias("s_last"), of("teacher").alias("t_last")).where(F.col("s_last").isNotNull() & F.col("t_last").isNotNull())
    order = Window.partitionBy("ex_id").orderBy("s_last")
    before = lambda c, first: F.lag(c, 1, first).over(order)
    return met.select(
        "ex_id", (F.row_number().over(order) - 1).alias("span_no"),
        (before("s_last", -1) + 1).alias("s_start"), (F.col("s_last") + 1).alias("s_end"),
        (before("t_last", -1) + 1).alias("t_start"), (F.col("t_last") + 1).alias("t_end"),
        before("byte_end", 0).alias("byte_start"), "byte_end",
    )


def alignment_report(tokens: DataFrame, max_span: int = MAX_SPAN) -> DataFrame:
    """Per example: span counts, granularity, and the first fault that makes the alignment unusable (null if none)."""
    side = lambda s, x: F.sum(F.when(F.col("side") == s, x).otherwise(0))
    totals = tokens.groupBy("ex_id").agg(
        side("student", F.lit(1)).alias("n_student"), side("teacher", F.lit(1)).alias("n_teacher"),
        side("student", F.octet_length("token").cast("bigint")).alias("student_bytes"), side("teacher", F.octet_length("token").cast("bigint")).alias("teacher_bytes"),
    )
    spans = aligned_spans(tokens).groupBy("ex_id").agg(
        F.count("*").alias("n_spans"), F.max(F.col("s_end") - F.col("s_start")).alias("longest"), F.max("s_end").alias("s_done"), F.max("t_end").alias("t_done"),
        F.count_if((F.col("s_end") - F.col("s_start") == 1) & (F.col("t_end") - F.col("t_start") == 1)).alias("one_to_one"),
    )
    fault = (
        F.when(F.col("student_bytes") != F.col("teacher_bytes"), "byte_length")
        .when(F.col("longest") > max_span, "long_span")
        .when((F.coalesce("s_done", F.lit(0)) != F.col("n_student")) | (F.coalesce("t_done", F.lit(0)) != F.col("n_teacher")), "leftover")
    )
    joined = totals.join(spans, "ex_id", "left")
    n = F.coalesce("n_spans", F.lit(0))
    return joined.select("ex_id", "n_student", "n_teacher", n.alias("n_spans"), F.coalesce("one_to_one", F.lit(0)).alias("one_to_one"), F.coalesce(F.try_divide(n, F.col("n_student")), F.lit(0.0)).alias("granularity"), fault.alias("fault"))


def span_kinds(tokens: DataFrame) -> DataFrame:
    """Each span with its kind: A for one token each, B for more, DROP when empty or with a special token."""
    spans = aligned_spans(tokens)
    special = tokens.where("is_special").select("ex_id", F.col("side").alias("sp_side"), F.col("idx").alias("sp_idx"))
    at = spans.select("ex_id", "span_no", F.explode(F.flatten(F.array(
        F.transform(F.sequence("s_start", F.col("s_end") - 1), lambda i: F.struct(F.lit("student").alias("sp_side"), i.alias("sp_idx"))),
        F.transform(F.sequence("t_start", F.col("t_end") - 1), lambda i: F.struct(F.lit("teacher").alias("sp_side"), i.alias("sp_idx"))),
    ))).alias("p")).select("ex_id", "span_no", "p.*")
    marked = at.join(special, ["ex_id", "sp_side", "sp_idx"]).groupBy("ex_id", "span_no").agg(F.bool_or(F.col("sp_side") == "student").alias("s_special"), F.bool_or(F.col("sp_side") == "teacher").alias("t_special"))
    kind = (
        F.when(F.col("byte_end") == F.col("byte_start"), "DROP_empty")
        .when(F.coalesce("s_special", F.lit(False)), "DROP_student_special")
        .when(F.coalesce("t_special", F.lit(False)), "DROP_teacher_special")
        .when((F.col("s_end") - F.col("s_start") == 1) & (F.col("t_end") - F.col("t_start") == 1), "A")
        .otherwise("B")
    )
    return spans.join(marked, ["ex_id", "span_no"], "left").withColumn("kind", kind).drop("s_special", "t_special")


def span_sums(tokens: DataFrame) -> DataFrame:
    """Sums of both sides' log probabilities over each span.

    A token's span is the number of common ends before it, counted over the tokens of its side; so each span is summed
    by itself, without a range join. All steps share one exchange by ``ex_id``.
    """
    ends = byte_ends(_slim(tokens, "logprob"))
    meeting = Window.partitionBy("ex_id", "byte_end", "occurrence")
    met = ends.withColumn("met", ((F.min("side").over(meeting) != F.max("side").over(meeting)) & F.col("side").isin("student", "teacher")).cast("int"))
    stream = Window.partitionBy("ex_id", "side").orderBy("idx")
    before = F.coalesce(F.sum("met").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = met.withColumns({"span_no": before, "spans": F.sum("met").over(Window.partitionBy("ex_id", "side"))})
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("logprob"))), F.lit(0.0))
    whole = placed.where(F.col("span_no") < F.col("spans"))  # past the last common end there is no span
    return whole.groupBy("ex_id", "span_no").agg(of("student").alias("s_sum"), of("teacher").alias("t_sum"))


def exact_map(vocab: DataFrame) -> DataFrame:
    """Teacher id to student id of tokens whose bytes are unique on both sides; specials take no part.

    ``vocab`` is (side, token_id, bytes, is_special); one exchange by the bytes serves counting and pairing.
    """
    of = lambda side: F.col("side") == side
    paired = vocab.where(~F.col("is_special")).groupBy("bytes").agg(
        F.count_if(of("student")).alias("ns"), F.count_if(of("teacher")).alias("nt"), F.max(F.when(of("student"), F.col("token_id"))).alias("student_id"), F.max(F.when(of("teacher"), F.col("token_id"))).alias("teacher_id")
    )
    return paired.where((F.col("ns") == 1) & (F.col("nt") == 1)).select("teacher_id", "student_id")


def coarse_reverse_kl(rows: DataFrame, coverage: float = COVERAGE, floor: float = FLOOR) -> DataFrame:
    """Reverse KL per position over the mapped candidates and one event for all others.

    ``rows`` is (position, t_lp, s_lp, mapped). Null where the mapped candidates hold less than
    ``coverage`` of the teacher's listed mass; the mass of the others is at least ``floor``.
    """
    on = F.col("mapped")
    sums = rows.groupBy("position").agg(
        F.sum(F.exp("t_lp")).alias("listed"), F.coalesce(F.sum(F.when(on, F.exp("t_lp"))), F.lit(0.0)).alias("t_mass"), F.coalesce(F.sum(F.when(on, F.exp("s_lp"))), F.lit(0.0)).alias("s_mass"),
        F.coalesce(F.sum(F.when(on, F.exp("s_lp") * (F.col("s_lp") - F.col("t_lp")))), F.lit(0.0)).alias("inner"), F.count_if(on).alias("n_mapped"),
    )
    share = F.coalesce(F.try_divide(F.col("t_mass"), F.col("listed")), F.lit(0.0))
    rest = 1 - F.col("t_mass")
    other_t = F.log(F.greatest(rest, F.lit(floor)))
    other_s = F.when(F.col("s_mass") >= 1, F.log(F.lit(floor))).otherwise(F.log1p(-F.col("s_mass")))
    gated = (F.col("n_mapped") > 0) & (share >= coverage)
    return sums.select("position", share.alias("coverage"), F.when(gated, F.col("inner") + F.exp(other_s) * (other_s - other_t)).alias("kl"), F.when(gated, rest < -floor).alias("clamped"))


def topk_reverse_kl(rows: DataFrame) -> DataFrame:
    """Reverse KL per position with both sides renormalised over the listed candidates."""
    lists = rows.groupBy("position").agg(F.collect_list(F.struct("s_lp", "t_lp")).alias("c"))  # as many as the provider lists
    s, t = F.transform("c", lambda x: x["s_lp"]), F.transform("c", lambda x: x["t_lp"])
    shifted = lists.withColumns({"zs": log_sum_exp(s), "zt": log_sum_exp(t)})
    term = lambda acc, x: acc + F.exp(x["s_lp"] - F.col("zs")) * ((x["s_lp"] - F.col("zs")) - (x["t_lp"] - F.col("zt")))
    return shifted.select("position", F.aggregate("c", F.lit(0.0).cast("double"), term).alias("kl"))


def surrogate(rows: DataFrame) -> DataFrame:
    """Per example the mean of (s - t) * s over supervised tokens, 0 without any, and the mean log ratio."""
    s, t = F.col("s_lp"), F.col("t_lp")
    on = F.col("supervised")
    return rows.groupBy("ex_id").agg(
        F.coalesce(F.avg(F.when(on, (s - t) * s)), F.lit(0.0)).alias("loss"), F.coalesce(F.avg(F.when(on, s - t)), F.lit(0.0)).alias("mean_log_ratio"), F.count_if(on).alias("n_tokens")
    )


def fingerprint(rows: DataFrame, key: str, value: Column, by: str) -> DataFrame:
    """SHA-256 over ``id:hex`` lines in the order of the numeric ids, one per ``by``.

    The hash is fed line by line from sorted batches, so no list of the ids is ever held.
    """
    lines = rows.select(F.col(by).cast("string").alias("by"), F.col(key).cast("bigint").alias("id"), F.concat(F.col(key).cast("string"), F.lit(":"), F.lower(F.hex(value))).alias("line"))
    ordered = lines.where(F.col("line").isNotNull()).repartition("by").sortWithinPartitions("by", "id", "line")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["by", "sha256"]
        row = lambda: pa.record_batch([pa.array([at], pa.string()), pa.array([held.hexdigest()], pa.string())], names=names)
        at, held = None, None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            a = 0
            while a < len(keys):
                b = a + 1
                while b < len(keys) and keys[b] == keys[a]:
                    b += 1
                if held is None or keys[a] != at:
                    if held is not None:
                        yield row()
                    at, held = keys[a], hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update("\n".join(batch.column(2).slice(a, b - a).to_pylist()).encode())
                a = b
        if held is not None:
            yield row()

    return ordered.mapInArrow(work, "by string, sha256 string").withColumnRenamed("by", by)


def masked_labels(prompt: Column, action: Column, limit: int) -> Column:
    """Labels of prompt and action: -100 over the prompt, cut to ``limit``; null where nothing is supervised."""
    labels = F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), action), 1, limit)
    return F.when((F.size(action) > 0) & (F.size(prompt) < limit), labels)


def padded(ids: Column, width: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))
