"""Runs of repeated words within documents, by a descending-LCP Kruskal.

A run is a stretch of words with a smallest period q, no shorter than 2 * q,
that no neighbouring word extends. Its first two periods are suffixes of the
document that share all of the run but q words. So suffixes are sorted, edges
between neighbours of that order are taken by decreasing common prefix, and
their classes are united. A class keeps its positions in order; positions that
become neighbours in a class share exactly the edge's prefix, and where they are
no further apart than that, they seed a run with their distance as its smallest
period (a shorter one would have put a position between them before).

Documents are independent, so nothing is shuffled. Within a task some megabytes
of texts go together through numpy; only words in stretches that occur twice in
their document get into the sort.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayscope.llm.words import U, mixed

#: Words of the shortest run.
SHORTEST = 12
#: Bytes of text that are handled together; a longer text goes alone.
CHUNK = 1 << 22
#: What separates words, as the class of a regular expression.
SEPARATORS = r"[\x20\x09-\x0D]"
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def recurring(ids: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Marks the words within stretches of ``size`` words that occur more than once in their document (a hash may mark more)."""
    covered = np.zeros(len(ids), bool)
    if len(ids) < size:
        return covered
    spread = mixed(ids.astype(U) + (doc.astype(U) << U(36)))
    key = spread[: len(ids) - size + 1].copy()
    for k in range(1, size):
        key = key * U(0x9E3779B97F4A7C15) + spread[k : len(ids) - size + 1 + k]
    at = np.flatnonzero(doc[: len(key)] == doc[size - 1 :])
    bucket = (mixed(key[at]) & U((1 << 22) - 1)).astype(np.int64)
    at = at[np.bincount(bucket, minlength=1 << 22)[bucket] > 1]
    order = at[np.argsort(key[at])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    for k in range(size):
        covered[order[twice] + k] = True
    return covered


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the suffixes of ``symbols``, and their ranks by their first 1, 2, 4... symbols.

    Prefix doubling: each round sorts only what earlier rounds left equal. The last symbol must be unique.
    """
    order = np.argsort(symbols, kind="stable")
    n = len(symbols)
    heads = np.ones(n, bool)
    heads[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    ranks, length = [rank], 1
    while True:
        alone = heads & np.append(heads[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            return order, ranks
        held = order[open_at]
        group, after = rank[held], rank[np.minimum(held + length, n - 1)]
        by = np.lexsort((after, group))
        held, group, after = held[by], group[by], after[by]
        order[open_at] = held
        fresh = np.ones(len(held), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        heads[open_at] = fresh
        rank = rank.copy()
        rank[held] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        ranks.append(rank)
        length *= 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """The symbols that each suffix shares with the next one in order."""
    a, b = order[:-1].copy(), order[1:].copy()
    shared, last = np.zeros(len(a), np.int64), len(order) - 1
    for k in range(len(ranks) - 1, -1, -1):
        step = (ranks[k][a] == ranks[k][b]).astype(np.int64) << k
        shared += step
        a, b = np.minimum(a + step, last), np.minimum(b + step, last)
    return shared


def seeds(left: list[int], right: list[int], shared: list[int], shortest: int) -> tuple[list[int], list[int], list[int]]:
    """Pairs of positions and their common prefix, no shorter than their distance, from edges by decreasing prefix."""
    members: dict[int, list[int]] = {}
    parent: dict[int, int] = {}
    first, distance, prefix = [], [], []
    for a, b, common in zip(left, right, shared, strict=True):
        while (up := parent.get(a, a)) != a:
            parent[a] = a = parent.get(up, up)
        while (up := parent.get(b, b)) != b:
            parent[b] = b = parent.get(up, up)
        large, small = members.get(a) or [a], members.pop(b, None) or [b]
        if len(large) < len(small):
            members.pop(a, None)
            a, b, large, small = b, a, small, large
        parent[b] = a
        members[a] = large
        places = [bisect_left(large, x) for x in small]
        for k, (x, i) in enumerate(zip(small, places, strict=True)):
            # Of small positions in one gap the first and the last become neighbours of large ones.
            if i and (not k or places[k - 1] != i) and (d := x - large[i - 1]) <= common and d + common >= shortest:
                first.append(large[i - 1])
                distance.append(d)
                prefix.append(common)
            if i < len(large) and (k + 1 == len(small) or places[k + 1] != i) and (d := large[i] - x) <= common and d + common >= shortest:
                first.append(x)
                distance.append(d)
                prefix.append(common)
        for x, i in zip(reversed(small), reversed(places), strict=True):
            large.insert(i, x)
    return first, distance, prefix


def runs(ids: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, periods and lengths of the runs of all documents, by start and period; ``doc`` numbers each word's document, in order."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = (shortest + 1) // 2
    places = np.flatnonzero(recurring(ids, doc, least))
    if not len(places):
        return none
    # What recurs, with a symbol of its own after each stretch; a word isn't the same one in another document.
    ends = np.ones(len(places), bool)
    ends[:-1] = (np.diff(places) != 1) | (doc[places[1:]] != doc[places[:-1]])
    at = np.arange(len(places)) + np.cumsum(ends) - ends
    symbols = np.empty(len(places) + int(ends.sum()), np.int64)
    where = np.full(len(symbols), -1, np.int64)
    where[at] = places
    symbols[at] = np.unique(doc[places] * (int(ids.max()) + 1) + ids[places], return_inverse=True)[1]
    gaps = np.flatnonzero(where < 0)
    symbols[gaps] = len(symbols) + np.arange(len(gaps))
    order, ranks = suffix_order(symbols)
    shared = common_prefixes(order, ranks)
    edges = np.flatnonzero(shared >= least)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    first, period, prefix = (np.array(x, np.int64) for x in seeds(where[order[edges]].tolist(), where[order[edges + 1]].tolist(), shared[edges].tolist(), shortest))
    if not len(first):
        return none
    # A seed is a run's first one if the word before doesn't keep the period.
    before = np.maximum(first - 1, 0)
    whole = (first == 0) | (doc[before] != doc[first]) | (ids[before] != ids[before + period])
    first, period, prefix = first[whole], period[whole], prefix[whole]
    by = np.lexsort((period, first))
    return first[by], period[by], (period + prefix)[by]


def hexed(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def described(doc_ids: list, texts: list[bytes | None], shortest: int) -> list[tuple]:
    """A row of SCHEMA for each text."""
    split = [(t or b"").split() for t in texts]  # of bytes, this splits at SEPARATORS
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(edges[-1]))
    first, period, length = runs(ids, np.repeat(np.arange(len(split)), sizes), shortest)
    cuts = np.searchsorted(first, edges).tolist()
    nothing, out = hexed(b""), []
    for k, words in enumerate(split):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            out.append((doc_ids[k], 0, None, None, None, None, nothing, hexed(b" ".join(words))))
            continue
        found = list(zip((first[a:b] - edges[k]).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
        kept = np.ones(len(words), bool)
        for s, n, q in found:
            kept[s + q : s + n] = False
        s, n, q = max(found, key=lambda r: (r[1], -r[0], -r[2]))
        listed = "".join(f"{i},{j},{p}\n" for i, j, p in found)
        out.append((doc_ids[k], b - a, s, n, q, 1000 * n // q, hexed(listed.encode()), hexed(b" ".join(compress(words, kept.tolist())))))
    return out


def describer(shortest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [pa.int64()] * 6 + [pa.string()] * 2
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def all_described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            chunk = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // CHUNK
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    rows = described(batch.column(0).slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist(), shortest)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return all_described


def periodic_runs(documents: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Each row's runs of at least ``shortest`` words, its longest one, and digests of all and of what is left without the repetitions.

    Columns are those of SCHEMA; start is a word's number from 0, the text of
    runs_sha256 has a line ``start,length,period`` a run, that of
    collapsed_sha256 the words that are in no run behind its first period,
    joined by blanks. Of equally long runs the one that starts first is shown,
    then the one of the shorter period. A null or empty text has no words and no
    runs. Rows are independent: repeated rows and null doc_ids give a row each.
    An empty table gives an empty result; other columns are not read.
    """
    return documents.select("doc_id", "text").mapInArrow(describer(shortest), SCHEMA)


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """doc_id and text of ``documents``; every tenth text, by the crc32 of its doc_id, gets a periodic end.

    Its words i >= a become its words a + (i - a) % p, with a and p from the
    crc32, joined by blanks. Texts without words and those of null doc_ids stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = documents.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    rows = rows.withColumn("words", F.when(F.col("g").isNotNull(), F.filter(F.split(F.coalesce("text", F.lit("")), SEPARATORS + "+"), lambda w: w != "")))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil(rest / F.col("p")).cast("int")
    repeated = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(period, times))), F.lit(1), F.col("n"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
