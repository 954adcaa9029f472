"""Cutting oversized items into pieces at natural boundaries, with overlap.

Long texts are cut into ranges of bytes, which are spread over the tasks before any is read, so no task
tokenises a whole giant text. A range yields its number of tokens, a table of the natural boundaries
within it, and what its neighbours must know of its edges: whether it starts and ends in a word, and the
line ends, white space and sentence end at both edges. Stitching the tables in order settles what lies on
an edge, however much white space surrounds it, so the result doesn't depend on the ranges. A prefix sum of
the lengths turns local into global token offsets, and the cuts are chosen over these tables in one ordered
pass that holds no more than one piece's boundaries. Pieces are then emitted by offset, again range by range.

A token is a maximal run of letters, digits and underscores, or any other single character that is
not white space. White space belongs to the piece of the token before it. A cut is taken at the
strongest boundary (message, paragraph, line, sentence) in the second half of the room, else at the
strongest anywhere in it beyond the overlap, else between two tokens.

Defined results: null or no messages give no pieces, null contents have no tokens; an item within the
limit gives one piece if asked for; a repeated row counts once; items with a null id take no part;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_BYTES = 16_384
SLAB_BYTES = 4_000_000  # texts that are tokenised side by side
WORD_CUT, SENTENCE, LINE, PARAGRAPH, MESSAGE = range(5)
KIND_NAMES = ("word", "sentence", "line", "paragraph", "message")
SENTENCE_ENDS = ".!?…。！？"
#: What a range knows by itself: ``cold`` counts its tokens as if a token began with it, ``at`` and ``kind`` are the
#: natural boundaries past its first token; the rest is for its neighbours.
TABLE_SCHEMA = (
    "segment_id bigint, msg int, part int, cold bigint, at array<int>, kind array<tinyint>, "
    "word_first boolean, word_last boolean, lead_lines bigint, lead_blank boolean, lines_to_last bigint, lines bigint, sentence_last boolean, solid_last boolean"
)
PIECE_SCHEMA = "segment_id bigint, piece_no int, start_token bigint, end_token bigint, n_tokens bigint, cut string"
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """By code point: 0 white space, 1 letter, digit or underscore, 2 anything else."""
    global _classes
    if _classes is None:
        kinds = bytearray(b"\x02") * 0x110000
        for point in range(0x110000):
            c = chr(point)
            if c.isalnum() or point == 0x5F:
                kinds[point] = 1
            elif c.isspace():
                kinds[point] = 0
        _classes = np.frombuffer(bytes(kinds), np.uint8)
    return _classes


def _slabs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SLAB_BYTES`` together."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        past = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, past + SLAB_BYTES, side="right")))
        yield at, stop
        at = stop


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts laid end to end, and where each text begins (with one end more)."""
    plain = texts.to_pylist()
    points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([0, *map(len, plain)])


def _starts(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of code points, and the positions at which tokens start; a text's first word starts one."""
    classes = char_classes()[points]
    word = classes == 1
    before = np.concatenate([[False], word[:-1]]) if word.size else word
    before[begins[:-1][begins[:-1] < begins[1:]]] = False
    return classes, np.flatnonzero((classes == 2) | (word & ~before))


def range_table(texts: pa.Array) -> list[pa.Array]:
    """The columns of ``TABLE_SCHEMA`` past the keys, of ranges of text that are read side by side."""
    points, begins = _points(texts)
    classes, starts = _starts(points, begins)
    first, end = begins[:-1], begins[1:]
    filled = first < end
    lines = np.concatenate([[0], np.cumsum(points == 10)])
    of = np.searchsorted(begins, starts, side="right") - 1  # the text of each token; an empty one has none
    cold = np.bincount(of, minlength=len(texts))
    begin_token = np.concatenate([[0], np.cumsum(cold)])
    place = np.arange(points.size)
    solid = np.maximum.accumulate(np.where(classes != 0, place, -1)) if points.size else place  # the last solid character so far
    ends = np.isin(points, [ord(c) for c in SENTENCE_ENDS])
    before = np.concatenate([[-1], solid[:-1]])[starts] if starts.size else starts
    breaks = lines[starts] - lines[before + 1]
    kind = np.where(breaks >= 2, PARAGRAPH, np.where(breaks == 1, LINE, np.where(ends[np.maximum(before, 0)] & (before < starts - 1), SENTENCE, WORD_CUT)))
    local = np.arange(starts.size) - begin_token[of]
    natural = (kind != WORD_CUT) & (local > 0)
    some = cold > 0
    lead = np.where(some, starts[np.minimum(begin_token[:-1], max(starts.size - 1, 0))] if starts.size else end, end)
    last = np.where(some, solid[np.maximum(end - 1, 0)] if points.size else 0, first)
    at_first, at_end = np.where(filled, first, 0), np.where(filled, end - 1, 0)
    word = classes == 1 if points.size else np.zeros(1, bool)
    here = classes != 0 if points.size else np.zeros(1, bool)
    sentence = ends if points.size else np.zeros(1, bool)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[natural], minlength=len(texts)))]), pa.int32())
    return [
        pa.array(cold, pa.int64()),
        pa.ListArray.from_arrays(offsets, pa.array(local[natural], pa.int32())),
        pa.ListArray.from_arrays(offsets, pa.array(kind[natural], pa.int8())),
        pa.array(filled & word[at_first]),
        pa.array(filled & word[at_end]),
        pa.array(lines[lead] - lines[first], pa.int64()),
        pa.array(lead > first),
        pa.array(np.where(some, lines[last] - lines[first], 0), pa.int64()),
        pa.array(lines[end] - lines[first], pa.int64()),
        pa.array(some & sentence[np.where(some, last, 0)]),
        pa.array(filled & here[at_end]),
    ]


def _cut_ranges(batches: Iterator[pa.RecordBatch], range_bytes: int) -> Iterator[pa.RecordBatch]:
    """Texts in pieces of about ``range_bytes`` bytes that end between characters; only the bytes at the ends are read."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column(3)[i].as_buffer()
            view, cuts = memoryview(data), [0]
            while cuts[-1] < len(view):
                end = min(cuts[-1] + range_bytes, len(view))
                while end < len(view) and view[end] & 0xC0 == 0x80:
                    end += 1
                cuts.append(end)
            for a in range(0, len(cuts) - 1, 256):
                own = cuts[a : a + 257]
                k = len(own) - 1
                same = [pa.concat_arrays([batch.column(c).slice(i, 1)] * k) for c in (0, 1, 2)]
                texts = pa.array([str(view[x:y], "utf-8", "replace") for x, y in zip(own, own[1:])], pa.string())
                yield pa.record_batch([*same, pa.array(range(a, a + k), pa.int32()), texts], names=["segment_id", "msg", "role", "part", "text"])


def _ranges(segments: DataFrame, range_bytes: int) -> DataFrame:
    """The texts in ranges: (segment_id, msg, role, part, text); those of long texts are spread over the tasks."""
    spark = segments.sparkSession
    messages = segments.where(F.col("segment_id").isNotNull()).select(F.col("segment_id").cast("bigint").alias("segment_id"), F.posexplode("messages").alias("msg", "message"))
    texts = messages.select("segment_id", "msg", F.col("message")["role"].alias("role"), F.coalesce(F.col("message")["content"], F.lit("")).alias("text"))
    short = texts.where(F.octet_length("text") <= range_bytes).select("segment_id", "msg", "role", F.lit(0).alias("part"), "text")
    long = texts.where(F.octet_length("text") > range_bytes).mapInArrow(lambda b: _cut_ranges(b, range_bytes), "segment_id bigint, msg int, role string, part int, text string")
    # a number of partitions that isn't merged by size: few bytes of text are much work
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return short.unionByName(long.repartition(tasks, "segment_id", "msg", "part"))


def boundary_tables(segments: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per range of the texts: (segment_id, msg, part, n_tokens, at, kind, joined, lead_kind, offset).

    ``joined`` says that the range begins within a word, whose token is the range's before, and that ``at``
    counts that token; ``lead_kind`` is the boundary before its first token; ``offset`` is the number of the
    item's tokens before it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in TABLE_SCHEMA.split(", ")]
        for batch in batches:
            for a, b in _slabs(batch.column(3)):
                own = batch.slice(a, b - a)
                yield pa.record_batch([*own.columns[:3], *range_table(own.column(3))], names=names)

    tables = _ranges(segments, range_bytes).select("segment_id", "msg", "part", "text").mapInArrow(work, TABLE_SCHEMA)
    order = Window.partitionBy("segment_id").orderBy("msg", "part")
    again = (F.lag("msg").over(order) == F.col("msg")) & (F.lag("part").over(order) == F.col("part"))
    once = tables.withColumn("again", F.coalesce(again, F.lit(False))).where(~F.col("again")).drop("again")  # a repeated row's ranges lie beside their twins
    # stitching within a message
    text = Window.partitionBy("segment_id", "msg").orderBy("part")
    past = text.rowsBetween(Window.unboundedPreceding, -1)
    before = once.withColumns(
        {
            "joined": F.col("word_first") & F.coalesce(F.lag("word_last").over(text), F.lit(False)),
            "lines_before": F.coalesce(F.sum("lines").over(past), F.lit(0)),
            "touches": F.coalesce(F.lag("solid_last").over(text), F.lit(False)),
            "sentence_before": F.coalesce(F.last(F.when(F.col("cold") > 0, F.col("sentence_last")), ignorenulls=True).over(past), F.lit(False)),
        }
    ).withColumn("last_line", F.when(F.col("cold") > 0, F.col("lines_before") + F.col("lines_to_last")))
    last_line = F.last("last_line", ignorenulls=True).over(past)  # null before the message's first token
    breaks = F.col("lines_before") + F.col("lead_lines") - last_line
    edge = (
        F.when(last_line.isNull(), MESSAGE)
        .when(breaks >= 2, PARAGRAPH)
        .when(breaks == 1, LINE)
        .when(F.col("sentence_before") & (F.col("lead_blank") | ~F.col("touches")), SENTENCE)
        .otherwise(WORD_CUT)
    )
    stitched = before.withColumns({"lead_kind": F.when(F.col("joined") | (F.col("cold") == 0), WORD_CUT).otherwise(edge).cast("tinyint"), "n_tokens": F.col("cold") - F.col("joined").cast("bigint")})
    return stitched.select(
        "segment_id", "msg", "part", "n_tokens", "at", "kind", "joined", "lead_kind", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")
    )


class _Cutter:
    """Chooses the cuts of one item while its boundary tables arrive in order."""

    def __init__(self, segment: int, limit: int, overlap: int):
        self.segment, self.limit, self.overlap = segment, limit, overlap
        self.start = self.end = self.piece = 0
        self.at, self.kind = np.empty(0, np.int64), np.empty(0, np.int8)

    def feed(self, offset: int, tokens: int, at: np.ndarray, kind: np.ndarray) -> Iterator[tuple]:
        self.at = np.concatenate([self.at, at.astype(np.int64) + offset])
        self.kind = np.concatenate([self.kind, kind])
        self.end = offset + tokens
        while self.end - self.start > self.limit:
            yield self._cut()

    def _cut(self) -> tuple:
        low, high = self.start + self.overlap + 1, self.start + self.limit
        cut, kind = high, WORD_CUT
        for least in (max(low, self.start + self.limit // 2), low):
            a, b = np.searchsorted(self.at, least), np.searchsorted(self.at, high, side="right")
            if b > a:
                strongest = self.kind[a:b].max()
                i = a + int(np.flatnonzero(self.kind[a:b] == strongest)[-1])
                cut, kind = int(self.at[i]), int(strongest)
                break
        row = (self.segment, self.piece, self.start, cut, cut - self.start, KIND_NAMES[kind])
        self.piece, self.start = self.piece + 1, cut - self.overlap
        passed = np.searchsorted(self.at, self.start)
        self.at, self.kind = self.at[passed:], self.kind[passed:]
        return row

    def last(self) -> tuple:
        return (self.segment, self.piece, self.start, self.end, self.end - self.start, "end")


def piece_offsets(tables: DataFrame, limit: int = 2048, overlap: int = 128, whole_items: bool = False, clustered: bool = False) -> DataFrame:
    """Pieces by token offsets (see ``PIECE_SCHEMA``) of the items beyond ``limit``, or of all with ``whole_items``.

    ``clustered`` says that ``tables`` come straight from ``boundary_tables``, whose window has brought each
    item's rows together, so that they need no further exchange.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter: _Cutter | None = None
        rows: list[tuple] = []

        def close() -> None:
            if cutter is not None and cutter.end and (cutter.piece or whole_items):
                rows.append(cutter.last())

        def table() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["segment_id", "piece_no", "start_token", "end_token", "n_tokens", "cut"]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            ids, offsets, counts, leads, joined = (batch.column(k).to_pylist() for k in (0, 1, 2, 5, 6))
            at, kind = batch.column(3), batch.column(4)
            for i, segment in enumerate(ids):
                if cutter is None or cutter.segment != segment:
                    close()
                    cutter = _Cutter(segment, limit, overlap)
                if counts[i]:
                    own, kinds = at[i].values.to_numpy(zero_copy_only=False) - int(joined[i]), kind[i].values.to_numpy(zero_copy_only=False)
                    if leads[i]:
                        own, kinds = np.concatenate([[0], own]), np.concatenate([[leads[i]], kinds])
                    rows.extend(cutter.feed(offsets[i], counts[i], own, kinds))
            if len(rows) > 10_000:
                yield table()
                rows.clear()
        close()
        if rows:
            yield table()

    together = tables if clustered else tables.repartition("segment_id")
    ordered = together.sortWithinPartitions("segment_id", "msg", "part").select("segment_id", "offset", "n_tokens", "at", "kind", "lead_kind", "joined")
    return ordered.mapInArrow(work, PIECE_SCHEMA)


def emit_pieces(segments: DataFrame, tables: DataFrame, pieces: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The texts of pieces: (segment_id, piece_no, n_tokens, cut, messages ARRAY<STRUCT<msg, role, content>>).

    Ranges and pieces meet by buckets of token offsets, so an item's ranges aren't compared with all its pieces.
    """
    width = 65_536
    # what precedes a range's first token belongs to the token before it: the rest of a word, or white space
    tail = (F.col("offset") > 0) & ((F.col("part") > 0) | (F.col("n_tokens") == 0))
    spans = tables.withColumn("tail", tail).select(
        "segment_id", "msg", "part", "joined", "tail", F.col("offset").alias("begin"), "n_tokens", (F.col("offset") - F.col("tail").cast("int")).alias("offset"), F.greatest(F.col("n_tokens") + F.col("tail").cast("int"), F.lit(1)).alias("length")
    )
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / F.lit(width)), F.floor((b - 1) / F.lit(width))))
    left = spans.withColumn("bucket", bucket(F.col("offset"), F.col("offset") + F.col("length")))
    right = pieces.select("segment_id", "piece_no", "start_token", "end_token", F.col("n_tokens").alias("size"), "cut").withColumn("bucket", bucket(F.col("start_token"), F.col("end_token")))
    low, high = F.greatest("offset", "start_token"), F.least(F.col("offset") + F.col("length"), F.col("end_token"))
    meets = left.join(right, ["segment_id", "bucket"]).where((low < high) & (F.floor(low / F.lit(width)) == F.col("bucket")))
    wanted = meets.groupBy("segment_id", "msg", "part", "joined").agg(
        F.collect_list(F.struct("piece_no", "tail", (low - F.col("begin")).cast("int").alias("a"), (high - F.col("begin")).cast("int").alias("b"), "size", "cut")).alias("wanted")
    )
    texts = _ranges(segments, range_bytes).join(wanted, ["segment_id", "msg", "part"]).dropDuplicates(["segment_id", "msg", "part"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text = row["text"]
                points, begins = _points(pa.array([text], pa.string()))
                starts = _starts(points, begins)[1][int(row["joined"]) :]
                for w in row["wanted"]:
                    whole_lead = w["a"] < 0 or (w["a"] == 0 and not w["tail"]) or not starts.size
                    a = 0 if whole_lead else int(starts[w["a"]])
                    b = len(text) if w["b"] >= starts.size else int(starts[max(w["b"], 0)])
                    rows.append((row["segment_id"], w["piece_no"], w["size"], w["cut"], row["msg"], row["part"], row["role"], text[a:b]))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                names = ["segment_id", "piece_no", "n_tokens", "cut", "msg", "part", "role", "content"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    slices = texts.mapInArrow(work, "segment_id bigint, piece_no int, n_tokens bigint, cut string, msg int, part int, role string, content string")
    by_message = slices.groupBy("segment_id", "piece_no", "n_tokens", "cut", "msg", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]), "").alias("content"))
    return by_message.groupBy("segment_id", "piece_no", "n_tokens", "cut").agg(F.array_sort(F.collect_list(F.struct("msg", "role", "content"))).alias("messages"))


def oversized_segments(segments: DataFrame, limit: int = 2048, overlap: int = 128) -> DataFrame:
    """The pieces, by offset, of all segments beyond ``limit`` tokens."""
    return piece_offsets(boundary_tables(segments), limit, overlap, clustered=True)
