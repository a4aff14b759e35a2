"""Tables that outlive a job: written once to the folder that all executors share.

The folder is the one that the session names in ``spark.checkpoint.dir``; one of
our own is set only where that is unset and all runs on one machine (tests, a laptop).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWEST, HIGHEST = -(2**63), 2**63 - 1


def row_key() -> tuple[Column, Column]:
    """doc, text_key: what tells a row with doc_id and text from all that differ from it.

    text_key has 63 hashed bits of the text, and its sign tells a null doc_id
    from the lowest one. A null text counts as empty.
    """
    hashed, lowest = F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(LOWEST).cast("long")
    key = F.when(F.col("doc_id").isNull(), hashed.bitwiseOR(lowest)).otherwise(hashed.bitwiseAND(F.lit(HIGHEST).cast("long")))
    return F.coalesce("doc_id", lowest), key


def row_keys(documents: DataFrame) -> DataFrame:
    """doc, text_key, doc_id, text of ``documents``; a null text counts as empty."""
    doc, key = row_key()
    return documents.select(doc.alias("doc"), key.alias("text_key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="relayscope-"))
    return context.getCheckpointDir().rstrip("/")


#: With it Spark deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder; it goes when the driver's JVM ends.

    Cuts the lineage in a way that lost executors don't undo. A table that an
    operator no longer needs can go earlier, with ``dropped``. The shuffle files
    of the write go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/relayscope/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._relayscope_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table._relayscope_path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
