"""Continuous ingest: landed payloads into tables, batch by batch.

An extension: a stream of landed JSON files is folded into the tables that the
batch operators make, with the same operators. Batches are idempotent, as a
replayed batch upserts what it did before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relayscope.operators import ingest


CORRUPT = "_corrupt_record"


def landed(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of landed JSON rows, with the text of those that don't parse in CORRUPT."""
    return spark.readStream.schema(f"{schema}, {CORRUPT} string").option("maxFilesPerTrigger", files_per_batch).json(folder)


def upserts(rows: DataFrame, keys: Sequence[str], version: str, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, quarantine: str | None = None) -> StreamingQuery:
    """Each batch's last version of a key replaces the stored row, if it isn't older.

    Rows that don't parse, or lack a key, go to a folder of their batch below
    ``quarantine``, which a replay writes again; without one they fail the batch.
    """

    def fold(batch: DataFrame, number: int) -> None:
        corrupt = F.col(CORRUPT) if CORRUPT in batch.columns else F.lit(None).cast("string")
        lacking = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
        bad = batch.where(corrupt.isNotNull() | lacking)
        if quarantine is not None:
            bad.select(F.coalesce(corrupt, F.to_json(F.struct(*keys))).alias("text"), F.when(corrupt.isNotNull(), "no JSON").otherwise("no key").alias("reason")).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        elif not bad.isEmpty():
            raise ValueError(f"batch {number} has rows that can't be used, and there is no place to keep them")
        batch = batch.where(corrupt.isNull() & ~lacking).drop(CORRUPT)
        whole = F.struct(version, *[c for c in batch.columns if c != version])
        fresh = batch.groupBy(*keys).agg(F.max(whole).alias("row")).select("row.*").select(*batch.columns)
        stored = read()
        newer = stored.select(*keys, F.col(version).alias("stored_version"))
        fresh = fresh.join(newer, list(keys), "left").where(F.col("stored_version").isNull() | (F.col(version) >= F.col("stored_version"))).select(*batch.columns)
        write(ingest.upserted(stored, fresh, keys), number)

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """window, event_type, n: events in tumbling windows, with rows later than the watermark left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
