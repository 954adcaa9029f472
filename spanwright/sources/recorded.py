"""A Python data source over recorded merged pull requests (JSON lines), with the connector's own filters."""

from __future__ import annotations

import fnmatch
import io
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "number int, title string, body string, merged_at string, base_sha string, head_sha string, is_draft boolean, changed_files array<string>"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RecordedPullRequests(DataSource):
    """``spark.read.format("recorded_prs").option("path", ...).option("since", ...).option("until", ...)``.

    ``path`` is a file or a folder of any file system that executors share (``file://``, ``hdfs://``, ``s3://``), of which
    the files named like ``pattern`` (``*.jsonl``) are read. One partition per file; drafts, rows outside the dates and
    rows without a base drop out at the source.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_prs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def _system(self) -> tuple[fs.FileSystem, str]:
        path = self.options["path"]
        return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def partitions(self) -> list[_File]:
        system, path = self._system()
        if system.get_file_info(path).type == fs.FileType.File:
            return [_File(path)]
        found = system.get_file_info(fs.FileSelector(path))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.options.get("pattern", "*.jsonl"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        since, until = self.options.get("since", ""), self.options.get("until", "~")
        with self._system()[0].open_input_stream(partition.path) as raw:
            for line in io.TextIOWrapper(raw, encoding="utf-8"):
                if not line.strip():
                    continue
                d = json.loads(line)
                day = (d.get("merged_at") or "")[:10]
                if d.get("is_draft") or not d.get("base_sha") or not day or not since <= day <= until:
                    continue
                yield (d.get("number"), d.get("title"), d.get("body"), d.get("merged_at"), d.get("base_sha"), d.get("head_sha"), bool(d.get("is_draft")), d.get("changed_files") or [])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedPullRequests)
