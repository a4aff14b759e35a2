"""Exact dedup by counting quotient filters.

Each partition packs the fingerprints of its texts into counting quotient
filters, one for each range of quotients. Filters of a range merge without loss,
by sorted remainders. A fingerprint with a count above one sends its documents
to a comparison of whole texts; the others are unique and done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayscope.llm.shared import written

#: A fingerprint has so many bits for the range, the quotient in it, and the remainder.
RANGE_BITS, QUOTIENT_BITS, REMAINDER_BITS = 12, 8, 32
SLOTS = 1 << QUOTIENT_BITS
FILTER = "range int, used binary, remainders binary, counts binary"


def packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A filter of one range: slots used by each quotient, then remainders and counts in their order.

    keys: sorted and distinct, quotient and remainder together.
    """
    used = np.bincount((keys >> np.uint64(REMAINDER_BITS)).astype(np.int64), minlength=SLOTS)
    return (
        used.astype("<u4").tobytes(),
        (keys & np.uint64((1 << REMAINDER_BITS) - 1)).astype("<u4").tobytes(),
        counts.astype("<u8").tobytes(),
    )


def unpacked(used: bytes, remainders: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts that ``packed`` was given."""
    quotient = np.repeat(np.arange(SLOTS, dtype=np.uint64), np.frombuffer(used, "<u4"))
    keys = quotient << np.uint64(REMAINDER_BITS) | np.frombuffer(remainders, "<u4").astype(np.uint64)
    return keys, np.frombuffer(counts, "<u8").astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, with the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def partition_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filters of one partition's column ``fingerprint``."""
    parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) for b in batches]
    if not parts:
        return
    prints = np.concatenate(parts)
    keys, counts = summed(prints, np.ones(len(prints), np.int64))
    ranges = (keys >> np.uint64(QUOTIENT_BITS + REMAINDER_BITS)).astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(keys) else []
    rows = [
        (int(ranges[i]), *packed(keys[i:j] & np.uint64((1 << (QUOTIENT_BITS + REMAINDER_BITS)) - 1), counts[i:j]))
        for i, j in zip(cuts, [*cuts[1:], len(keys)], strict=True)
    ]
    for i in range(0, len(rows), 1000):
        part = list(zip(*rows[i : i + 1000], strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[0], pa.int32()), *(pa.array(x, pa.binary()) for x in part[1:])],
            names=["range", "used", "remainders", "counts"],
        )


def merged_counts(table: pa.Table) -> pa.Table:
    """Of all filters of a range: the fingerprints that count more than one."""
    columns = [table.column(c).to_pylist() for c in ("used", "remainders", "counts")]
    parts = [unpacked(*x) for x in zip(*columns, strict=True)]
    keys, counts = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
    at = np.uint64(table.column("range")[0].as_py()) << np.uint64(QUOTIENT_BITS + REMAINDER_BITS)
    return pa.table({"fingerprint": (keys[counts > 1] | at).astype(np.int64), "n": counts[counts > 1]})


def fingerprint(text: Column) -> Column:
    """The bits of a text's fingerprint, from 0."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - RANGE_BITS - QUOTIENT_BITS - REMAINDER_BITS)


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """fingerprint, n: those that more than one row of ``prints`` has. A filter holds a slot for a
    fingerprint however many rows have it, so that a large group of copies is small before it moves."""
    filters = prints.select("fingerprint").mapInArrow(partition_filters, FILTER)
    return filters.groupBy("range").applyInArrow(merged_counts, "fingerprint long, n long")


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``documents``.

    Texts are equal when they are the same bytes; null counts as empty. Of equal
    texts the row with the largest doc_id stays. Rows that repeat a doc_id and
    its text share one fate; a null doc_id is the smallest. An empty table gives
    an empty result; other columns are not read.
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    light = written(
        texts.select("doc_id", fingerprint(F.col("text")).alias("fingerprint"), F.sha2("text", 256).alias("text_sha256")),
        "fingerprints",
    )
    candidates = light.join(repeated_fingerprints(light), "fingerprint", "left_semi").select(F.col("doc_id").alias("candidate")).distinct()
    # Grouping by the text itself compares bytes; copies meet in each map task first.
    groups = (
        texts.join(candidates, F.col("doc_id").eqNullSafe(F.col("candidate")), "left_semi")
        .groupBy("text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    return light.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        "text_sha256",
    )
