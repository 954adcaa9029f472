"""Session helpers shared by all operators: reading tables, cutting lineage, Python-side batching."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete what this session's operators, queries and streams wrote to the shared folder; how many paths.

    Call it when no result of theirs is needed any more.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def ship(spark: SparkSession) -> None:
    """Give the executors of a session this package, once; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spanwright-"), "spanwright.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("spanwright", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a local master may do without the setting; it then gets a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"spanwright-{os.getpid()}")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as parquet and read it back.

    This cuts lineage with data that survives the loss of any executor, and unlike
    ``checkpoint()`` it stays columnar, so later readers still prune columns.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sorted_groups(
    batches: Iterator[pa.RecordBatch],
    keys: list[str],
    work: Callable[[pa.Table], pa.Table | Iterator[pa.Table] | None],
    rows: int = 200_000,
) -> Iterator[pa.RecordBatch]:
    """Feed ``work`` with tables that hold whole groups of a partition sorted by ``keys``.

    Several small groups share a call, so that vectorised work pays its fixed cost once for
    about ``rows`` rows; a group is never divided between calls. ``work`` may yield its result in parts.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            out = work(table.combine_chunks())
            for part in [out] if out is None or isinstance(out, pa.Table) else out:
                if part is not None and part.num_rows:
                    yield from part.to_batches(max_chunksize=65_536)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        cut = _last_group_start(table, keys)
        if cut == 0:
            continue
        yield from emit(table.slice(0, cut))
        rest = table.slice(cut)
        held = pa.Table.from_batches(rest.to_batches()).combine_chunks().to_batches()
        count = rest.num_rows
    if held:
        yield from emit(pa.Table.from_batches(held))


def _last_group_start(table: pa.Table, keys: list[str]) -> int:
    """Row at which the last run of equal keys begins, by bisection over the sorted rows."""
    n = table.num_rows
    columns = [table.column(k) for k in keys]
    last = [c[n - 1].as_py() for c in columns]
    low, high = 0, n - 1
    while low < high:
        mid = (low + high) // 2
        if [c[mid].as_py() for c in columns] == last:
            high = mid
        else:
            low = mid + 1
    return low
