"""Near-duplicate removal over a stream of batches: what came first stays, whatever the cut into batches.

A text is dropped if it shares a band of its MinHash signature with one that came before and stays. The bands of the
texts that stay are the state: a table that each batch reads and extends. Inside a batch the rule is settled in rounds:
a text stays once no open text before it shares a band, and those that share a band with it go. That is what a single
loop over all texts would keep, so cuts don't matter, as long as ``order`` grows from batch to batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import dedup
from quern.operators.dedup import persisted, release

BAND = ["band", "slice"]


def losers(bands: DataFrame) -> DataFrame:
    """The ``id`` of those that go among rows ``id``, ``band``, ``slice``: in ascending order, each that shares a band with an
    earlier one that stays.

    Only bands with two texts or more enter the rounds. A round asks for the least open text of every band: a text that is
    the least of all its bands stays, and every other text in one of its bands goes. The least open text of all always
    stays, so rounds follow chains, not the corpus; a band's holders are only ever counted and compared with their least,
    never paired.
    """
    held = bands.groupBy(*BAND).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select(*BAND)
    open_, gone = persisted(bands.join(held, BAND, "left_semi").select("id", *BAND).distinct()), None
    while True:
        least = persisted(open_.groupBy(*BAND).agg(F.min("id").alias("first")))
        firsts = least.groupBy(F.col("first").alias("id")).agg(F.count("*").alias("n_first"))
        sizes = open_.groupBy("id").agg(F.count("*").alias("n"))
        stay = sizes.join(firsts, "id").where("n = n_first").select("id")
        # bands whose least text stays are closed: all their holders are decided
        closed = persisted(least.join(stay, least["first"] == stay["id"]).select("first", *BAND))
        out = persisted(open_.join(closed, BAND).where("id > first").select("id").distinct())
        gone = out if gone is None else gone.unionAll(out)
        decided = out.unionAll(closed.select(F.col("first").alias("id")))
        before, open_ = open_, persisted(open_.join(decided, "id", "left_anti"))
        for table in (before, least, closed):
            release(table)
        if open_.isEmpty():
            release(open_)
            return gone


def settle_first(bands: DataFrame) -> DataFrame:
    """The ``id`` of those that stay among rows ``id``, ``band``, ``slice``: all but the ``losers``."""
    return bands.select("id").distinct().join(losers(bands), "id", "left_anti")


def first_wins(docs: DataFrame, order: str = "doc_id", b: int = 42, k: int = 128, n: int = 5, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that stay, and their bands (``band``, ``slice``), given the bands ``stored`` by earlier batches.

    ``b`` bands of a signature of ``k``: with 42 bands of three, two texts of similarity 0.7 share one almost surely. Rows
    whose text or ``order`` is null are never compared and stay; ``order`` should be distinct.
    """
    used = b * (k // b)
    marks = dedup.minhash(docs.select(F.col(order).alias("_key"), "text").where("_key is not null and text is not null"), used, n, key="_key")
    bands = persisted(dedup.bands(marks, b, "_key").select(F.col("_key").alias("id"), "band", F.xxhash64("slice").alias("slice")))
    if stored is None:
        gone = losers(bands)
    else:
        hit = persisted(bands.join(stored, BAND, "left_semi").select("id").distinct())
        gone = hit.unionAll(losers(bands.join(hit, "id", "left_anti")))
    return docs.join(gone, docs[order] == gone["id"], "left_anti"), bands.join(gone, "id", "left_anti").select(*BAND).distinct()


def state_of(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The bands kept by the batches under ``folder`` (those numbered below ``before``, if given); None if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path) or not len(files.listStatus(path)):
        return None
    rows = spark.read.schema("band int, slice long, batch long").option("basePath", folder).parquet(folder)
    return rows.where(F.col("batch") < before).select(*BAND) if before is not None else rows.select(*BAND)


def keep_first_of_stream(stream: DataFrame, out: str, state: str, checkpoint: str, order: str = "doc_id", **options) -> StreamingQuery:
    """Start the stream: rows that stay are written under ``out``, their bands under ``state``, a folder for each batch.

    A batch that is run again after a failure overwrites its own folders and reads only the state of batches before it, so
    the result is the same.
    """

    def batch(docs: DataFrame, number: int) -> None:
        stay, bands = first_wins(docs, order, stored=state_of(docs.sparkSession, state, number), **options)
        stay.write.mode("overwrite").parquet(f"{out}/batch={number}")
        bands.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

