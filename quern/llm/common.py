"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's Parquet tables; one that fits a single row group is dealt over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none, a local session gets one temporary folder a process; on a cluster, whose executors
    would each write to their own disk, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="quern-"))
        found = _OWN[0]
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors don't undo it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a ``durable`` table that no later plan reads, as a loop does with its earlier rounds."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._quern_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % n


def blocks(batch: pa.RecordBatch, text: str, max_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut a record batch into runs of rows of about ``max_chars`` characters, so that memory does not follow the batch."""
    column = batch.column(batch.schema.get_field_index(text))
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    sizes = column.to_pylist() if len(column) == 0 else pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > max_chars:
            yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start), column.slice(start).to_pylist()


def join_counted(rows: DataFrame, counts: DataFrame, keys: list[str], most: int = 2000) -> DataFrame:
    """``rows`` inner-joined to ``counts``, whose ``keys`` are unique and whose ``_rows`` says how many rows have them.

    Keys with more than a ``most``-th of all rows, of which there are fewer than ``most``, are broadcast, so no task
    takes such a key whole; the others meet in the shuffle. ``counts`` should be a written table: it is read three times.
    """
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    hot = counts.where(F.col("_rows") > total / most)
    met = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counts.where(F.col("_rows") <= total / most), keys)
    return met.unionByName(rest)
