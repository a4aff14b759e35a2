"""The nearest vectors of many queries, against scores pair by pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from relayscope.operators import evals, retrieval

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [1.0], [0.0] * 4, [0.0, -0.0, 0.0, 0.0], [NAN, 1.0, 0.0, 0.0], [INF, 1.0, 0.0, 0.0], [1e-170] * 4, [1e170] * 4, [1e-120, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0], [2.0, 1.0]]


def vectors(seed: int, n: int) -> list:
    """Vectors of length 4 with many ties: equal ones, others of the same direction, and odd ones."""
    r = random.Random(seed)
    some = [[r.gauss(0, 1) for _ in range(4)] for _ in range(n // 4)]
    return ODD + [[s * x for x in r.choice(some)] for s in r.choices((1.0, 1.0, 2.0, -0.5), k=n - len(ODD))]


def told(rows) -> list:
    return sorted((r["query"], r["rank"], r["id"], repr(r["score"])) for r in rows)


def pair_by_pair(candidates, queries, k, floor):
    pairs = candidates.crossJoin(queries).select("query", "id", retrieval.cosine(F.col("embedding"), F.col("q")).alias("score"))
    pairs = pairs if floor is None else pairs.where(F.col("score") >= floor)
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def test_nearest_are_those_of_all_pairs_with_their_ties(spark, monkeypatch):
    """In several blocks, tasks and batches; a task multiplies matrices and never joins pairs of rows."""
    candidates = spark.createDataFrame([(f"ä{i * 37 % 300:03d}" if i % 2 else f"b{i}", v) for i, v in enumerate(vectors(1, 300))], "id string, embedding array<double>")
    queries = spark.createDataFrame(list(enumerate(vectors(2, 60))), "query int, q array<double>")
    want = {(k, floor): told(pair_by_pair(candidates, queries, k, floor).collect()) for k, floor in ((5, None), (3, 0.25), (400, None))}
    monkeypatch.setattr(retrieval, "BLOCK", 13)
    monkeypatch.setattr(retrieval, "PAIRS", 1300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for (k, floor), rows in want.items():
            assert told(retrieval.batch_topk(candidates, queries, k, floor).collect()) == rows, (k, floor)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.undo()
    best = retrieval.batch_topk(candidates, queries, 5)
    assert told(best.collect()) == want[5, None] and "NestedLoop" not in best._jdf.queryExecution().toString()
    assert retrieval.batch_topk(candidates, queries.limit(0), 5).collect() == [] and retrieval.batch_topk(candidates.limit(0), queries, 5).collect() == []


def test_gold_of_a_topic_is_not_written_out_for_each_question(spark):
    """The same figures from gold by topic and by question, and those of sets written out; questions without gold, and a topic that nobody asks about."""
    r = random.Random(3)
    tools = [(i, [r.gauss(0, 1) for _ in range(3)], i % 4 == 3, f"t{i % 5}" if i % 7 else None) for i in range(80)]
    asked = [(i, [r.gauss(0, 1) for _ in range(3)], f"t{i % 7}" if i % 5 else None) for i in range(30)]
    df = spark.createDataFrame(tools, "id int, embedding array<double>, synthetic boolean, label string")
    questions = spark.createDataFrame(asked, "query int, q array<double>, topic string")
    gold = df.where("not synthetic and label is not null").select(F.col("label").alias("topic"), "id")
    (by_topic,) = evals.sweep_point(df, questions, gold.union(gold)).collect()
    (by_question,) = evals.sweep_point(df, questions, questions.select("query", "topic").join(gold, "topic").select("query", "id")).collect()
    chosen = {}
    for row in pair_by_pair(df, questions, retrieval.TOOLS, retrieval.FLOOR).collect():
        chosen.setdefault(row["query"], []).append(row["id"])
    sets = [({i for i in chosen.get(n, []) if i % 4 != 3}, {i for i, _, synthetic, label in tools if not synthetic and label and label == topic}) for n, _, topic in asked]
    want = {
        "recall": sum(len(f & g) / len(g) if g else 1.0 for f, g in sets) / 30, "jaccard": sum(len(f & g) / len(f | g) if f | g else 1.0 for f, g in sets) / 30,
        "offered": sum(len(f) for f, _ in sets) / 30, "crowd_out": sum(i % 4 == 3 for ids in chosen.values() for i in ids) / sum(map(len, chosen.values())),
    }
    assert by_topic.asDict() == pytest.approx(want) and by_question.asDict() == pytest.approx(want)
    (nothing,) = evals.sweep_point(df.limit(0), questions, gold.limit(0)).collect()
    assert nothing.asDict() == {"recall": 1.0, "jaccard": 1.0, "offered": 0.0, "crowd_out": 0.0}
