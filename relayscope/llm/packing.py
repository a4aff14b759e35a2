"""Best-two-fit packing of tokenised documents into sequences of one length.

A sequence is filled greedily, each time with the longest piece that fits. Then
its shortest piece may give way to two unpacked pieces that fill the gap more
tightly. The choices depend on lengths alone, so they are made on the histogram
of lengths (as many entries as a sequence has tokens, however many documents
there are): as long as the pieces last, the same lengths are chosen again, and
one pattern stands for all those sequences. Pieces are numbered within their
length by Spark, and the number says which sequence and offset a piece gets.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relayscope.llm.shared import written

SEQUENCE = 2048
#: Ends a document.
SEPARATOR = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


@lru_cache(maxsize=1)
def encoder(ranks: str, vocabulary: str):
    """The byte-level BPE of a rank file; its ids are those of the ``tokenizers`` file of the same vocabulary.

    That file's added tokens are tokens wherever a text spells them, special ones too.
    """
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(vocabulary, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if odd := [t["content"] for t in added if t["lstrip"] or t["rstrip"] or t["single_word"]]:
        raise ValueError(f"added tokens that depend on what is around them: {odd}")
    special = {t["content"]: t["id"] for t in added}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` tokens: all but the first have ``most``."""
    edges = [0, *range(n - (n - 1) // most * most, n + 1, most)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def piece_maker(ranks: str, vocabulary: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding, part = encoder(ranks, vocabulary), TaskContext.get().partitionId()
        seen = [0] * (most + 1)
        for batch in batches:
            out: list[tuple] = []
            known: dict[str, list[tuple[int, int, int]]] = {}  # copies within a batch are encoded once
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if (pieces := known.get(text)) is None:
                    ids = np.array([*coding.encode(text, allowed_special="all"), SEPARATOR], "<u4")
                    pieces = known[text] = [(a, b - a, zlib.crc32(ids[a:b])) for a, b in cut(len(ids), most)]
                for k, (start, length, crc) in enumerate(pieces):
                    out.append((doc, k, start, length, crc, part, seen[length]))
                    seen[length] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"],
                )

    return made


def best_two_fit(counts: dict[int, int], most: int) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, sequences of this kind) that use up ``counts`` pieces of each length."""
    left = np.zeros(most + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    kinds = []
    while left.any():
        spare, gap, lengths = left.copy(), most, []
        while gap and len(there := np.flatnonzero(spare[: gap + 1])):
            longest = int(there[-1])
            lengths.append(longest)
            spare[longest] -= 1
            gap -= longest
        if gap and len(lengths) > 1:
            shortest, best = lengths[-1], (lengths[-1], 0, 0)
            there = np.flatnonzero(spare[: shortest + gap + 1])
            for one in there[::-1]:
                rest = shortest + gap - int(one)
                if 2 * one < best[0]:
                    break
                if rest > 0 and len(fits := there[there <= min(rest, one)]):
                    two = int(fits[-1])
                    if two == one and spare[one] < 2:
                        two = int(fits[-2]) if len(fits) > 1 else 0
                    if two and one + two > best[0]:
                        best = (int(one) + two, int(one), two)
            if best[1]:
                lengths[-1:] = best[1:]
        used, times = np.unique(lengths, return_counts=True)
        n = int((left[used] // times).min())
        left[used] -= n * times
        kinds.append((lengths, n))
    return kinds


def slots(kinds: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first numbers of its runs of pieces, and each run's first sequence and offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for lengths, n in kinds:
        offset = 0
        for length in lengths:
            runs.setdefault(length, []).append((given.get(length, 0), sequence, offset))
            given[length] = given.get(length, 0) + n
            offset += length
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def placer(table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.empty_like(number), np.empty_like(number)
            for one in np.unique(length):
                at = length == one
                first, sequences, offsets = table[int(one)]
                run = np.searchsorted(first, number[at], side="right") - 1
                sequence[at] = sequences[run] + number[at] - first[run]
                offset[at] = offsets[run]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return placed


def packed(documents: DataFrame, ranks: str | None = None, most: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of ``documents``.

    A document is the ids of its whole text and then SEPARATOR; null counts as
    an empty text, which is the separator alone. Documents over ``most`` tokens
    are cut, the first piece taking what is over. Every row is a document of its
    own, repeated rows and null doc_ids too. An empty table gives an empty
    result; other columns are not read. ranks: the rank file of the vocabulary;
    vocabulary: its ``tokenizers`` file, for the added tokens.
    """
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    pieces = written(documents.select("doc_id", "text").mapInArrow(piece_maker(ranks, vocabulary, most), PIECES), "pieces")
    # The number of a piece among all of its length: its place in its part, after the parts before.
    parts = pieces.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(firsts, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).withColumn("number", F.col("first") + F.col("place"))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(
        placer(slots(best_two_fit(histogram, most))),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
