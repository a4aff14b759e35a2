"""Files that people write and runs leave: areas and question sets in JSON or YAML, result caches, baselines."""

from __future__ import annotations

import json
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = "cache_format int, qid string, klass int, metrics map<string,double>, predicted array<string>, gold array<string>, error string"


def document(spark: SparkSession, path: str) -> Any:
    """The content of one small file, by Spark's readers; YAML where a YAML library is installed."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if PurePosixPath(path).suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        raise RuntimeError(f"{path}: reading YAML needs the yaml package; write it as JSON") from None
    return yaml.safe_load(text)


def areas(spark: SparkSession, path: str) -> DataFrame:
    """name, globs of a file with a list of {name, globs}; a name that comes twice raises."""
    listed = document(spark, path)
    names = [a["name"] for a in listed]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"{path}: areas listed twice: {', '.join(twice)}")
    return spark.createDataFrame([(a["name"], list(a["globs"])) for a in listed], "name string, globs array<string>")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """place, qid, class, question, as_of, gold_tools, method, args, gold, points of a file with a list of questions, as ``evals.gold_errors`` checks them."""
    rows = []
    for place, q in enumerate(document(spark, path)):
        query = q.get("gold_query") or {}
        args = {k: None if v is None else str(v) for k, v in (query.get("args") or {}).items()}
        rows.append((place, q.get("id"), q.get("class"), q.get("question"), None if q.get("as_of") is None else str(q["as_of"]), q.get("gold_tools") or [], query.get("method"), args, [str(c) for c in q.get("gold_chunks") or []], q.get("gold_answer_points") or []))
    table = spark.createDataFrame(rows, "place int, qid string, class int, question string, as_of string, gold_tools array<string>, method string, args map<string,string>, gold array<string>, points array<string>")
    return table.withColumn("as_of", F.col("as_of").try_cast("timestamp_ntz"))


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """place, scenario, session, prompt, tool, area, since, clarification of a file with a list of scenarios, a row a session, as ``evals.suite_errors`` checks them; a scenario without sessions has one without a prompt."""
    rows = []
    for place, scenario in enumerate(document(spark, path)):
        for number, session in enumerate(scenario.get("sessions") or [{}]):
            expect = session.get("expect") or {}
            told = [None if v is None else str(v) for v in (session.get("prompt"), expect.get("tool"), expect.get("area"), expect.get("since"), session.get("clarification"))]
            rows.append((place, scenario.get("id"), number, *told))
    return spark.createDataFrame(rows, "place int, scenario string, session int, prompt string, tool string, area string, since string, clarification string")


def cache(spark: SparkSession, path: str, cache_format: int) -> DataFrame:
    """The results of a cache (a line of JSON each) in this format; older ones are left out."""
    return spark.read.schema(CACHE).json(path).where(F.col("cache_format") == cache_format)


def append_cache(results: DataFrame, path: str, cache_format: int) -> None:
    """Add results; none that failed is kept."""
    results.where("error is null").withColumn("cache_format", F.lit(cache_format)).write.mode("append").json(path)
