import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanwright.llm import splitting as S

SCHEMA = "segment_id bigint, messages array<struct<role string, content string, tool_call_id string>>, n_tokens int, msg string, part string"
TOKEN = re.compile(r"\w+|[^\w\s]")


def count(text):
    return len(TOKEN.findall(text or ""))


def texts(seed):
    rng = random.Random(seed)
    pieces = ["word ", "snake_case ", "x=1; ", "End. ", "Ende! \n", "line\n", "para\n\n", "日本語。", "é\u0301 ", "{\"k\":[1,2]}", " " * 40, "a" * 70, "²Ⅷ ", "\u200b", "\r\n"]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 400)))


@pytest.mark.parametrize("range_bytes", [16, 64, 300, 65_536])
def test_pieces_cover_everything(spark, range_bytes):
    segments = {k: [texts(100 * k + j) for j in range(4)] for k in range(12)}
    segments[50], segments[51] = ["z" * 5000 + " tail"] * 3, ["", "   ", "."]
    data = [(k, [("user", t, None) for t in ts], 0, "clash", "clash") for k, ts in segments.items()]
    data += data[:2] + [(None, [("user", "a b c", None)], 0, "x", "x"), (90, None, 0, "x", "x"), (91, [], 0, "x", "x"), (92, [("user", None, None)], 0, "x", "x")]
    df = spark.createDataFrame(data, SCHEMA)
    limit, overlap = 150, 20
    tables = S.boundary_tables(df, range_bytes)
    pieces = S.piece_offsets(tables, limit, overlap)
    offsets = {}
    for r in pieces.collect():
        assert (r.segment_id, r.piece_no) not in offsets
        offsets[r.segment_id, r.piece_no] = r
    sizes = {k: sum(map(count, ts)) for k, ts in segments.items()}
    assert {k for k, _ in offsets} == {k for k, n in sizes.items() if n > limit}
    emitted = {(r.segment_id, r.piece_no): r for r in S.emit_pieces(df, tables, pieces, range_bytes).collect()}
    assert set(emitted) == set(offsets)
    for (k, no), o in offsets.items():
        assert o.n_tokens <= limit and o.end_token - o.start_token == o.n_tokens
        assert sum(count(m.content) for m in emitted[k, no].messages) == o.n_tokens
        if no:
            assert o.start_token == offsets[k, no - 1].end_token - overlap
        else:
            assert o.start_token == 0
        if (k, no + 1) not in offsets:
            assert o.end_token == sizes[k]
    for k, ts in segments.items():
        if sizes[k] <= limit:
            continue
        own = [emitted[k, no] for no in range(sum(1 for s, _ in offsets if s == k))]
        for m, text in enumerate(ts):
            if not count(text):
                continue
            parts = [x.content for p in own for x in p.messages if x.msg == m]
            # each part goes on where the text so far ends, with overlap
            built = parts[0]
            assert text.startswith(built)
            for part in parts[1:]:
                at = max(i for i in range(len(built) + 1) if text.startswith(part, i) and i <= len(built))
                built = text[: max(len(built), at + len(part))]
            assert built == text


def test_cuts_prefer_strong_boundaries(spark):
    words = " ".join(["w"] * 90)
    content = f"{words}.\n\n{words}. {words}\n{words}"
    df = spark.createDataFrame([(1, [("user", content, None)], None, "x", "x")], SCHEMA)
    rows = S.piece_offsets(S.boundary_tables(df), 150, 10).orderBy("piece_no").collect()
    assert rows[0].cut == "paragraph" and rows[0].end_token == 91


def test_counts_of_classes():
    for text in ("²Ⅷ_a é\u0301", "日本語。", "😀😀 x", "a\x1cb\x85c\u2028d", ""):
        assert S.range_table(pa.array([text], pa.string()))[0].to_pylist() == [count(text)]


def settled(spark, texts, range_bytes):
    """Tokens and boundaries of each text, whatever its ranges."""
    df = spark.createDataFrame([(k, [("user", t, None)], None, "x", "x") for k, t in enumerate(texts)], SCHEMA)
    found = {k: [0, []] for k in range(len(texts))}
    for r in S.boundary_tables(df, range_bytes).orderBy("segment_id", "part").collect():
        held = found[r.segment_id]
        assert held[0] == r.offset
        held[0] += r.n_tokens
        held[1] += [(r.offset, r.lead_kind)] * bool(r.lead_kind) + [(r.offset + a - r.joined, k) for a, k in zip(r.at, r.kind)]
    return found


def test_ranges_do_not_show(spark):
    long = ["word.\n\n" + " " * 700 + "Next one here", "End." + " " * 400 + "Next", "a" * 900, "x.\n" + " " * 300 + "\ny", " " * 500, "日本。" * 90 + "\n" + "é" * 200, "w.\u2028" * 80, "\n" * 200 + "a"]
    long += [texts(1000 + k) for k in range(12)]
    whole = settled(spark, long, 1 << 20)
    assert whole[0][1][1] == (2, S.PARAGRAPH)
    for size in (5, 17, 256):
        assert settled(spark, long, size) == whole


def test_a_giant_text_is_spread(spark):
    text = ("Some words of a sentence. And another one\nwith lines.\n\n" * 950_000)[: 50 << 20]
    df = spark.range(1).select(F.lit(7).cast("bigint").alias("segment_id"), F.array(F.struct(F.lit("user").alias("role"), F.lit(text).alias("content"), F.lit(None).cast("string").alias("tool_call_id"))).alias("messages"))
    spread = S._ranges(df, S.RANGE_BYTES).groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert len(spread) >= 8 and sum(r.n for r in spread) == len(text) and max(r.n for r in spread) < len(text) // 4
    pieces = S.oversized_segments(df)
    last = pieces.agg(F.max("end_token").alias("end"), F.max("n_tokens").alias("most"), F.count("*").alias("n")).first()
    assert last.end == count(text) and last.most <= 2048 and last.n >= last.end // 2048


def test_whole_items_and_empty(spark):
    df = spark.createDataFrame([(1, [("user", "a b", None)], None, "x", "x")], SCHEMA)
    assert [r.n_tokens for r in S.piece_offsets(S.boundary_tables(df), whole_items=True).collect()] == [2]
    assert S.oversized_segments(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        S.piece_offsets(S.boundary_tables(df), 100, 60)
