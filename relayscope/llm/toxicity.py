"""Toxicity by logistic regression, trained with FTRL-proximal.

Features are hashed: the words of a text, their pairs of neighbours, and pairs
that skip one word, each counted once for a text. Training follows McMahan et
al. (2013): every coordinate has a rate of its own, and L1 leaves most weights
at zero, so that the model is small enough to send to every task: it has at
most 2 ** BITS weights, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayscope.llm.shared import written
from relayscope.llm.words import NOT_ALPHANUMERIC, mixed, word_hashes

BITS = 20
U = np.uint64


@dataclass(frozen=True)
class Settings:
    """Of FTRL-proximal, and of the sample that it learns from.

    max_rows: at most so many labelled rows are learned from, those with the
    smallest hashes of their doc_id; one task learns from all of them.
    """

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.1
    epochs: int = 4
    max_rows: int = 40_000


def hashed_features(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, one text after the other, and how many each has."""
    rows = np.repeat(np.arange(len(counts)), counts)
    kinds, owners = [mixed(words)], [rows]
    for skip in (1, 2):
        same = rows[:-skip] == rows[skip:] if len(rows) > skip else np.zeros(0, bool)
        pairs = mixed(words[:-skip] * U(0xD6E8FEB86659FD93) + words[skip:] + U(skip)) if len(rows) > skip else words[:0]
        kinds.append(pairs[same])
        owners.append(rows[skip:][same] if len(rows) > skip else rows[:0])
    keys = np.concatenate(owners).astype(U) << U(BITS) | np.concatenate(kinds) >> U(64 - BITS)
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    return (keys & U((1 << BITS) - 1)).astype(np.int64), np.bincount((keys >> U(BITS)).astype(np.int64), minlength=len(counts))


def trained(features: list[np.ndarray], labels: np.ndarray, how: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after ``how.epochs`` passes over the rows in the order given."""
    z, n, bias, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        near = np.abs(z[at]) <= how.l1
        return np.where(near, 0.0, -(z[at] - np.sign(z[at]) * how.l1) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for at, label in zip(features, labels, strict=True):
            w = weights(at)
            error = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            square = error * error
            z[at] += error - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / how.alpha * w
            n[at] += square
            bias_n += square
            bias -= how.alpha / (how.beta + np.sqrt(bias_n)) * error
    return weights(slice(None)), bias


def trainer(how: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The weights that aren't zero, by feature, and the bias, as that of -1; no row for no rows."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features: list[np.ndarray] = []
        labels: list[np.ndarray] = []
        for batch in batches:
            labels.append(batch.column("toxic").to_numpy().astype(float))
            for _, _, words, counts in word_hashes(batch.column("text"), NOT_ALPHANUMERIC):
                found, sizes = hashed_features(words, counts)
                features += np.split(found.astype(np.int32), np.cumsum(sizes)[:-1])
        if features:
            w, bias = trained(features, np.concatenate(labels), how)
            used = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1].astype(np.int64)), pa.array(np.r_[w[used], bias])], names=["feature", "weight"])

    return train


def scorer(model, carried: tuple[str, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, values, bias = model.value
        w = np.zeros(1 << BITS)
        w[features] = values
        for batch in batches:
            ids, texts, *more = batch.columns
            for lo, hi, words, counts in word_hashes(texts, NOT_ALPHANUMERIC):
                found, sizes = hashed_features(words, counts)
                sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[found], minlength=len(sizes))
                score = 1 / (1 + np.exp(-np.clip(sums + bias, -700, 700))) if np.isfinite(bias) else np.zeros(len(sums))
                columns = [ids.slice(lo, hi - lo), pa.array(score), *(c.slice(lo, hi - lo) for c in more)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", *carried])

    return scored


def toxicity_scores(documents: DataFrame, labels: DataFrame, how: Settings | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns ``carried`` (strings) of each row of ``documents``.

    Learns from the documents that ``labels.toxic`` marks 0 or 1, but for those
    held out: crc32 of doc_id as text, modulo 5, is 0. A doc_id that is labelled
    more than once counts as toxic if any of its labels say so. Only the text
    makes a score; null counts as empty, and an empty text has the score of the
    bias. Without any label all scores are 0. Each row gets a score, repeated
    ones and null doc_ids (never held out) too; an empty table gives an empty
    result; other columns are not read.
    """
    spark, how = documents.sparkSession, how or Settings()
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    sample = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .where(~held_out)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("place", F.xxhash64("doc_id"))
        .orderBy("place", "doc_id")
        .limit(how.max_rows)
    )
    sample = written(sample, "sample")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    ordered = rows.repartition(1).sortWithinPartitions("place", "doc_id", F.xxhash64("text")).select("text", "toxic")
    # At most 2 ** BITS + 1 rows, however large the corpus is.
    model = ordered.mapInArrow(trainer(how), "feature long, weight double").toPandas()
    used, rest = model[model.feature >= 0], model[model.feature < 0]
    sent = spark.sparkContext.broadcast((used.feature.to_numpy(), used.weight.to_numpy(), rest.weight.iloc[0] if len(rest) else -np.inf))
    scores = documents.select("doc_id", "text", *carried).mapInArrow(scorer(sent, carried), ", ".join(["doc_id long, score double", *(f"{c} string" for c in carried)]))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *carried)
