"""Index maintenance: what to insert, embed again, leave or delete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayscope.operators.lineage import checkpointed


def conflicts(candidates: DataFrame) -> DataFrame:
    """id of the candidates with different contents, told by their hashes alone."""
    return hashes(candidates).where("low <> high").select("id")


def hashes(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("id").agg(F.min("content_sha").alias("low"), F.max("content_sha").alias("high"))


def delta(candidates: DataFrame, stored: DataFrame, prune: bool = True) -> DataFrame:
    """id, action: insert, update, skip or delete, by id and hash of the content.

    Equal candidates are one; a conflict makes the job fail when it comes to it.
    No candidates change nothing.
    """
    clash = F.raise_error(F.concat(F.lit("one id has different contents: "), F.col("id").cast("string"))).cast("string")
    new = hashes(candidates).select("id", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(clash).alias("new"))
    both = new.join(stored.select("id", F.col("content_sha").alias("old")), "id", "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") == F.col("new"), "skip").otherwise("update")
    rows = both.select("id", action.alias("action"))
    return rows if prune and not candidates.isEmpty() else rows.where("action <> 'delete'")


def pending(candidates: DataFrame, deltas: DataFrame) -> DataFrame:
    """The candidates to embed: those that are new or changed, each id once."""
    todo = deltas.where("action in ('insert', 'update')").select("id")
    return candidates.join(todo, "id", "left_semi").dropDuplicates(["id"])


def delta_stats(deltas: DataFrame, candidates: DataFrame) -> DataFrame:
    """key, n: rows of each action, and candidates of each source."""
    return deltas.groupBy(F.concat(F.lit("action:"), "action").alias("key")).agg(F.count("*").alias("n")).union(candidates.groupBy(F.concat(F.lit("source:"), "source")).agg(F.count("*")))


def drift(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """name, drift: missing, changed or orphaned tools."""
    both = catalog.select("name", F.col("embedding_text").alias("new")).join(stored.select("name", F.col("embedding_text").alias("old")), "name", "full_outer")
    kind = F.when(F.col("old").isNull(), "missing").when(F.col("new").isNull(), "orphaned").when(F.col("old") != F.col("new"), "changed")
    return both.select("name", kind.alias("drift")).where("drift is not null")


#: Parts of a stored index; a change rewrites the parts that it falls into.
PARTS = 64


def part_of(id: Column, parts: int) -> Column:
    return F.pmod(F.conv(F.left(F.md5(id.cast("string")), F.lit(7)), 16, 10).cast("long"), F.lit(parts)).cast("int")


def applied(path: str, candidates: DataFrame, embed: Callable[[DataFrame], DataFrame], parts: int = PARTS, prune: bool = True) -> DataFrame:
    """Brings the index stored at ``path`` to the candidates (id, content_sha and more), and returns part, inserted, updated, deleted of what was rewritten.

    The index lies in folders by hash of id. Only what is new or changed is
    embedded (``embed`` adds its columns), and only folders with a change are
    written again, with their other rows; the rest isn't touched, nor read beyond
    its hashes. New folders are complete before old ones go. A delta that was
    applied changes nothing when it is applied again. ``parts`` belongs to the
    index: it has to be the same every time.
    """
    spark = candidates.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    once = candidates.dropDuplicates(["id"])
    stored = spark.read.parquet(path) if files.exists(place) else None
    known = candidates.select("id", "content_sha").limit(0) if stored is None else stored.select("id", "content_sha")
    deltas = checkpointed(delta(candidates, known, prune).where("action <> 'skip'").withColumn("part", part_of(F.col("id"), parts)), "delta")
    touched = sorted(r["part"] for r in deltas.select("part").distinct().collect())  # at most ``parts``
    fresh = embed(once.join(deltas.where("action <> 'delete'").select("id", "part"), "id"))
    if stored is not None:
        kept = stored.where(F.col("part").isin(touched)).join(deltas.select("id"), "id", "left_anti")
        fresh = kept.unionByName(fresh.select(*kept.columns))
    # What is read from the index has to be elsewhere before its folders are replaced.
    staged = checkpointed(fresh, "parts")
    if touched:
        staged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        left = {r["part"] for r in staged.select("part").distinct().collect()}
        for part in set(touched) - left:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}"), True)
    of = lambda action: F.count_if(F.col("action") == action)
    return deltas.groupBy("part").agg(of("insert").alias("inserted"), of("update").alias("updated"), of("delete").alias("deleted"))
