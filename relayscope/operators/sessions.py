"""Sessions of a service: created or found by batches of requests, and ended once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayscope.operators.lineage import checkpointed


def resolved(sessions: DataFrame, requests: DataFrame, new_id: Column) -> tuple[DataFrame, DataFrame]:
    """All ``sessions`` (id, user_id, started_at, ended_at) after ``requests`` (request, user_id, session_id, at), and what each request got.

    A request without a session gets a new one, with ``new_id`` made of the
    request; one that names a session gets that, ended or not, and an unknown
    name is an error: request, session_id, created, error. Requests that made
    their session before find it, so that a batch may come again.
    """
    asked = F.nullif(F.col("session_id"), F.lit(""))
    wanted = requests.select("request", "user_id", "at", asked.alias("asked"), new_id.alias("new_id"))
    known = sessions.select(F.col("id").alias("known")).distinct()
    rows = checkpointed(wanted.join(known, F.coalesce("asked", "new_id") == F.col("known"), "left"), "requests")
    fresh = rows.where("asked is null and known is null")
    made = fresh.select(F.col("new_id").alias("id"), "user_id", F.col("at").alias("started_at"), F.lit(None).cast(sessions.schema["ended_at"].dataType).alias("ended_at"))
    lost = F.col("asked").isNotNull() & F.col("known").isNull()
    got = rows.select("request", F.when(~lost, F.coalesce("asked", "new_id")).alias("session_id"), (F.col("asked").isNull() & F.col("known").isNull()).alias("created"), F.when(lost, F.concat(F.lit("no session "), F.col("asked"))).alias("error"))
    return sessions.select("id", "user_id", "started_at", "ended_at").unionByName(made), got


def ended(sessions: DataFrame, endings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ``sessions`` after ``endings`` (session_id, at), and the ids of those that this closed, whose memories are due.

    A session ends once, by its first ending; one that has ended, or that isn't there, is left.
    """
    first = endings.groupBy(F.col("session_id").alias("ending")).agg(F.min("at").alias("ends"))
    rows = sessions.join(first, F.col("id") == F.col("ending"), "left")
    closing = F.col("ended_at").isNull() & F.col("ends").isNotNull()
    after = rows.withColumn("ended_at", F.coalesce("ended_at", "ends")).select(*sessions.columns)
    return after, rows.where(closing).select("id")
