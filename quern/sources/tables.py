"""Readers and writers: the tables, JSON arrays, seed lines, folders of source files, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def spread(df: DataFrame, least: int = 1 << 20, most: int = 64 << 20) -> DataFrame:
    """A small table dealt over all cores; larger tables as they are.

    A file is split between row groups only, so a table that fits one group is read, and everything narrow above it
    computed, by a single task. Between ``least`` and ``most`` bytes (half a usual row group) moving the rows costs less
    than that; above, the scan has tasks of its own and nothing is shuffled.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism) if least < size < most else df


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def read_json_array(spark: SparkSession, path: str, schema: str | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """Files that hold one JSON array of records each; missing keys take ``defaults`` (empty strings by default)."""
    reader = spark.read.option("multiLine", True)
    out = (reader.schema(schema) if schema else reader).json(path)
    texts = [c for c, kind in out.dtypes if kind == "string"]
    return out.fillna("" if defaults is None else defaults, subset=texts) if texts else out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of each line that is not blank, stripped of white space of every kind."""
    return spark.read.text(path).select(T.strip(F.col("value")).alias("text")).where("text <> ''")


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path`` and ``text`` of every file under ``folder``; bytes that are not UTF-8 are dropped, U+FFFD itself stays."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    # make_valid_utf8 puts U+FFFD where a byte is wrong, so one that the file holds waits as a noncharacter meanwhile.
    own, aside = F.lit(chr(0xFFFD)), F.lit(chr(0xFFFF))
    raw = F.replace(F.col("content").cast("string"), own, aside)
    return files.select("path", F.replace(F.replace(F.make_valid_utf8(raw), own, F.lit("")), aside, own).alias("text"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_json_lines(df: DataFrame, path: str, text: str | None = None, preview: int = 500) -> None:
    """Append records; the ``text`` column is stored as a preview of its first characters."""
    out = df.withColumn(text, F.substring(text, 1, preview)) if text else df
    out.write.mode("append").json(path)


def hash_split(key: Column, validation_percent: int = 10) -> Column:
    """True for rows of the validation part; the same rows at every run and partitioning."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100 < validation_percent


def metric_json(metrics: DataFrame, span: int = 10_000) -> DataFrame:
    """``name``, ``span``, ``history``: each metric's points (name, step, value) as JSON texts of ``span`` steps each, in
    order; a text never holds more points than that, however long the history is."""
    history = F.sort_array(F.collect_list(F.struct("step", "value")))
    return metrics.groupBy("name", F.floor(F.col("step") / span).cast("long").alias("span")).agg(F.to_json(history).alias("history"))


def flatten(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested structs as plain columns, named by the path of their fields."""
    from pyspark.sql.types import StructType

    def walk(schema: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            out += walk(f.dataType, here) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here))]
        return out

    return df.select(*walk(df.schema, ()))
