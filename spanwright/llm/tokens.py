"""Encoding of whole texts by the token automaton.

Defined results: a null and an empty text give no ids; a null id column stays null; every row gives
one row, repeated rows too; texts of any length are encoded whole; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.llm.automaton import automaton

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def tokenizer_file(spark: SparkSession, path: str | None = None):
    """The tokenizer's file as a broadcast value; the file is a published vocabulary of fixed size.

    ``path``, or the session's ``spark.spanwright.tokenizer``, names it.
    """
    path = path or spark.conf.get("spark.spanwright.tokenizer", DEFAULT_TOKENIZER)
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is no vocabulary file: {len(data)} bytes")
    return spark.sparkContext.broadcast(data)


def _lists(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    if ends[-1] >= 2**31:
        raise ValueError("a batch holds more ids than one list array can")
    flat = np.fromiter((i for r in rows for i in r), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row (id, ids) per row: the token ids of its text, without special tokens."""
    file = tokenizer_file(df.sparkSession, path)
    narrow = df.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = automaton(file.value).encode
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                ids = _lists([encode(t) if t else [] for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), ids], names=[id_col, "ids"])

    schema = T.StructType([narrow.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return narrow.mapInArrow(work, schema)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row (id, text) per row: the text whose ids these are; null ids give a null text."""
    file = tokenizer_file(df.sparkSession, path)
    narrow = df.select(F.col(id_col).alias(id_col), F.col(ids_col).alias("__ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = automaton(file.value).decode
        for batch in batches:
            texts = [None if i is None else decode(i) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return narrow.mapInArrow(work, T.StructType([narrow.schema[id_col], T.StructField("text", T.StringType())]))


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """One row (id, *keep, n_tokens) per row with a text that isn't empty."""
    file = tokenizer_file(df.sparkSession, path)
    narrow = df.where(F.length(text_col) > 0).select(id_col, *keep, F.col(text_col).alias("__text"))
    names = [id_col, *keep, "n_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = automaton(file.value).count
        for batch in batches:
            sizes = pa.array([count(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.record_batch([*batch.columns[:-1], sizes], names=names)

    schema = T.StructType([narrow.schema[c] for c in names[:-1]] + [T.StructField("n_tokens", T.LongType())])
    return narrow.mapInArrow(work, schema)
