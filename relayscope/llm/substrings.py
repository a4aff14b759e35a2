"""Removal of repeated long substrings, by distributed prefix doubling.

Positions get names for the 8, 16, 32 and 64 bytes that start there; a name of
twice the length comes from the pair of names at a position and at its offset.
Longer strings are named by the pair at their start and end, which overlap. Two
positions begin the same string of LENGTH bytes if and only if the pairs of
their 64-byte names at 0 and at LENGTH - 64 agree.

Spark sorts positions by name in two rounds, and a position whose name turns out
unique goes no further:

1. The least 32-byte name within a string says where its core lies: the 66 or 67
   bytes after or around the least name, depending on the half of the string
   that it is in. Equal strings have equal cores, and neighbouring positions
   mostly share theirs, so that a run of them is one row, sorted by the core's
   name and then by the whole run's. A run whose core no other run has is
   unique. Runs that are equal as a whole repeat the earliest of them. What
   stays open are runs that share their core with a different run: the edges of
   repeats.
2. The open runs' positions are sorted by their own LENGTH-byte names.

All comparisons are of whole corpora; what is compared has 128 bits of names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayscope.llm.shared import row_keys, written
from relayscope.llm.words import utf8

LENGTH, SHORT, LONG = 100, 32, 64
#: Places of the least name in a string, and those of its first half.
PLACES = LENGTH - SHORT + 1
HALF = (PLACES + 1) // 2
BLOCK = 1 << 18
#: Rows that are compared before they leave a task.
ROWS = 200_000
U = np.uint64
NAMED = "one long, two long, doc long, text_key long, at long, n int"
SPANS = "doc long, text_key long, at long, n int, open boolean"


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each pair of names."""
    x = a * U(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SHORT and LONG names at every position that has so many bytes after it."""
    n = len(data)
    if n < LONG:
        return np.zeros(0, U), np.zeros(0, U)
    name = paired(np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)), np.zeros(1, U))
    size, short = 8, None
    while size < LONG:
        name = paired(name[:-size], name[size:])
        size *= 2
        if size == SHORT:
            short = name
    return short, name


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row of each text, its start in the bytes, its start in the whole text).

    Short texts come many at once. A text longer than a block comes in pieces
    that overlap, so that every string of LENGTH bytes is whole in one piece.
    """
    data, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo <= BLOCK:
            yield data[lo:hi], np.arange(row, last), np.r_[offsets[row:last] - lo, hi - lo], np.zeros(last - row, np.int64)
        else:
            for at in range(lo, max(lo + 1, hi - LENGTH + 1), BLOCK):
                end = min(hi, at + BLOCK + LENGTH - 1)
                yield data[at:end], np.array([row]), np.array([0, end - at]), np.array([at - lo])
        row = last


def string_names(long: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the LENGTH bytes from each place."""
    return paired(long[at], long[at + LENGTH - LONG])


def core_names(long: np.ndarray, least: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Of the bytes that all strings have whose least name is at ``least``: late in them, or not."""
    start = np.where(late, least - HALF, least)
    size = np.where(late, HALF + SHORT, LENGTH - HALF + 1)
    return paired(paired(long[start], long[start + size - LONG]), late.astype(U))


def runs_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """core, whole, start, size of the runs of positions in one block; starts: of its texts, and its end."""
    none = np.zeros(0, np.int64)
    nothing = none.astype(U), none.astype(U), none, none
    if len(data) < LENGTH:
        return nothing
    short, long = names(data)
    least = sliding_least(short, PLACES)
    edge = np.zeros(len(data) + 1, np.int32)
    sizes = np.diff(starts)
    fits = sizes >= LENGTH
    np.add.at(edge, starts[:-1][fits], 1)
    np.add.at(edge, starts[:-1][fits] + sizes[fits] - LENGTH + 1, -1)
    places = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(places):
        return nothing
    fresh = np.ones(len(places), bool)
    fresh[1:] = (np.diff(places) > 1) | (least[places[1:]] != least[places[:-1]])
    first = np.flatnonzero(fresh)
    size = np.diff(np.r_[first, len(places)])
    a = places[first]
    inside = np.arange(2 * PLACES)
    hits = short[np.minimum(a[:, None] + inside, len(short) - 1)] == least[a][:, None]
    hits &= inside < (size + PLACES - 1)[:, None]
    once = (hits.sum(1) == 1) & (size <= PLACES)
    # A run with one least name has up to two cores.
    at, n = a[once], size[once]
    x = at + hits[once].argmax(1)
    cut = np.clip(x - HALF + 1, at, at + n)
    parts = []
    for late, start, count in ((True, at, cut - at), (False, cut, at + n - cut)):
        some = count > 0
        p, m = start[some], count[some]
        q = p + m - 1
        whole = paired(string_names(long, p), paired(string_names(long, q), m.astype(U)))
        parts.append((core_names(long, x[some], np.full(len(p), late)), whole, p, m))
    # Where a least name occurs again, each position is a run; with two in one string, the string is its own core.
    many = a[~once]
    if len(many):
        m = size[~once]
        p = np.repeat(many - (np.cumsum(m) - m), m) + np.arange(m.sum())
        for i in range(0, len(p), BLOCK // 16):
            at = p[i : i + BLOCK // 16]
            hits = short[at[:, None] + np.arange(PLACES)] == least[at][:, None]
            x = at + hits.argmax(1)
            own = string_names(long, at)
            core = np.where(hits.sum(1) == 1, core_names(long, x, x - at >= HALF), paired(own, U(2) + np.zeros(1, U)))
            parts.append((core, paired(own, paired(own, np.ones(1, U))), at, np.ones(len(at), np.int64)))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def differ(*columns: np.ndarray) -> np.ndarray:
    """Which rows aren't the same as the row before; the first one differs."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def first_of_their_names(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows of two names, document, its text's key, place and size: the first of each pair of names.

    The others repeat for sure: they come without names, neighbours as one. A
    row that is there twice (equal rows of the table are one document) counts once.
    """
    rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort(rows[4::-1])
    rows = [x[order] for x in rows]
    once = differ(*rows[:5])
    one, two, doc, key, at, n = (x[once] for x in rows)
    first = differ(one, two)
    keep, rest = np.flatnonzero(first), np.flatnonzero(~first)
    rest = rest[np.lexsort((at[rest], key[rest], doc[rest]))]
    start = differ(doc[rest], key[rest])
    start[1:] |= at[rest][1:] != (at + n)[rest][:-1]
    head = np.flatnonzero(start)
    sizes = np.add.reduceat(n[rest], head) if len(head) else n[:0]
    rest = rest[head]
    keys = [pa.array(np.r_[x[keep], x[rest]].view(np.int64), mask=np.arange(len(keep) + len(rest)) >= len(keep)) for x in (one, two)]
    more = [pa.array(np.r_[x[keep], x[rest]]) for x in (doc, key, at)]
    yield pa.RecordBatch.from_arrays([*keys, *more, pa.array(np.r_[n[keep], sizes].astype(np.int32))], names=["one", "two", "doc", "text_key", "at", "n"])


def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs, with a core's name and their own; see ``first_of_their_names``."""
    for batch in batches:
        docs, keys, parts = batch.column("doc").to_numpy(), batch.column("text_key").to_numpy(), []
        for data, rows, starts, before in blocks(batch.column("text")):
            core, whole, a, size = runs_of(data, starts)
            text = np.searchsorted(starts[1:], a, side="right")
            parts.append((core, whole, docs[rows[text]], keys[rows[text]], a - starts[text] + before[text], size))
            if sum(len(x[0]) for x in parts) > ROWS:
                yield from first_of_their_names(parts)
                parts = []
        if parts:
            yield from first_of_their_names(parts)


def spans(doc: np.ndarray, key: np.ndarray, at: np.ndarray, n: np.ndarray, is_open: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(doc), pa.array(key), pa.array(at), pa.array(n.astype(np.int32)), pa.array(is_open)]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "text_key", "at", "n", "open"])


def rows_once(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, without rows that equal the row before them but for the size."""
    last = None
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
        if len(rows[0]):
            once = differ(*rows[:5])
            once[0] = tuple(c[0] for c in rows[:5]) != last
            last = tuple(c[-1] for c in rows[:5])
            if once.any():
                yield [c[once] for c in rows]


def judge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted runs: those that repeat an earlier equal run, and the open ones.

    One row is carried from batch to batch, however many runs share a core.
    """
    held = None  # the first run of the latest core, not known yet to have company
    last = None
    for core, whole, doc, key, at, n in rows_once(batches):
        new_core, new_run = np.ones(len(core), bool), np.ones(len(core), bool)
        new_core[1:] = core[1:] != core[:-1]
        new_run[1:] = new_core[1:] | (whole[1:] != whole[:-1])
        if last is not None:
            new_core[0] = core[0] != last[0]
            new_run[0] = new_core[0] or whole[0] != last[1]
        last = (core[-1], whole[-1])
        # Company: a different run of the same core opens the first one too.
        group = np.cumsum(new_core)
        company = np.bincount(group, new_run & ~new_core, minlength=group[-1] + 1) > 0
        is_open = new_run & company[group]
        if held is not None and company[0]:
            yield spans(*(np.array([x]) for x in held), np.array([True]))
            held = None
        pick = is_open | ~new_run
        if pick.any():
            yield spans(doc[pick], key[pick], at[pick], n[pick], is_open[pick])
        if group[-1] > 0:
            k = int(np.flatnonzero(new_core)[-1])
            held = None if is_open[k] else (doc[k], key[k], at[k], n[k])


def find_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The positions of open runs by their names; as ``find_runs`` does with runs."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        docs, keys, parts = batch.column("doc").to_numpy(), batch.column("text_key").to_numpy(), []
        runs = batch.column("runs").to_pylist()
        for i in range(batch.num_rows):
            at, n = np.array([r["at"] for r in runs[i]]), np.array([r["n"] for r in runs[i]])
            place = np.unique(np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum()))
            text = data[offsets[i] : offsets[i + 1]]
            for lo in range(0, len(text), BLOCK):
                here = place[(place >= lo) & (place < lo + BLOCK)]
                if len(here):
                    _, long = names(text[lo : lo + BLOCK + LENGTH])
                    parts.append((long[here - lo], long[here - lo + LENGTH - LONG], np.full(len(here), docs[i]), np.full(len(here), keys[i]), here, np.ones(len(here), np.int64)))
            if sum(len(x[0]) for x in parts) > ROWS:
                yield from first_of_their_names(parts)
                parts = []
        if parts:
            yield from first_of_their_names(parts)


def judge_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted positions, those that aren't the first of their name."""
    last = None
    for one, two, doc, key, at, _ in rows_once(batches):
        again = ~differ(one, two)
        again[0] = (one[0], two[0]) == last
        last = (one[-1], two[-1])
        yield spans(doc[again], key[again], at[again], np.ones(again.sum()), np.zeros(again.sum(), bool))


def removed(text: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of bytes that strings starting at at .. at + n - 1 cover."""
    order = np.argsort(at, kind="stable")
    start, reach = at[order], np.maximum.accumulate((at + n + LENGTH - 1)[order])
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return list(zip(start[first].tolist(), reach[np.r_[first[1:] - 1, len(reach) - 1]].tolist(), strict=True))


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        out = []
        for i, (doc, runs) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("runs").to_pylist(), strict=True)):
            text = data[offsets[i] : offsets[i + 1]]
            gone = removed(text, np.array([r["at"] for r in runs]), np.array([r["n"] for r in runs])) if runs else []
            digest, at = hashlib.sha256(), 0
            for a, b in gone:
                digest.update(text[at:a].tobytes())
                at = b
            digest.update(text[at:].tobytes())
            out.append((doc, len(text), sum(b - a for a, b in gone), len(gone), digest.hexdigest(), [{"start": a, "stop": b} for a, b in gone]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        columns = zip(*out, strict=True) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_substrings(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of each row of ``documents``.

    A byte of a text's UTF-8 goes when a string of LENGTH bytes over it also
    starts earlier: in a smaller doc_id, or earlier in the same document.
    Matches don't cross documents, overlaps count, and strings are judged on the
    input. spans: the removed runs of bytes, [start, stop). Null counts as an
    empty text; a null doc_id comes before all others. Rows that repeat a doc_id
    and its text are one document and share its result; rows of one doc_id (or
    of none) with different texts are documents of their own, in the order of 63
    hashed bits of the text, by which they are told apart. An empty table gives an empty result; other columns are
    not read.
    """
    texts = row_keys(documents)
    document = ["doc", "text_key"]
    # A row without names is decided; such rows are dealt out evenly.
    deal = F.coalesce("one", F.xxhash64(*document, "at"))
    order = [F.col("one").isNull(), "one", "two", *document, "at"]
    runs = texts.select(*document, "text").mapInArrow(find_runs, NAMED)
    runs = runs.withColumn("deal", deal).repartition("deal").drop("deal")
    judged = written(runs.sortWithinPartitions(*order).mapInArrow(judge_all(judge_runs), SPANS), "runs")
    open_runs = judged.where("open").groupBy(*document).agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    positions = texts.select(*document, "text").join(open_runs, document).mapInArrow(find_positions, NAMED)
    positions = positions.withColumn("deal", deal).repartition("deal").drop("deal")
    again = written(positions.sortWithinPartitions(*order).mapInArrow(judge_all(judge_positions), SPANS), "positions")
    gone = judged.where("not open").select(*document, "at", "n").union(again.select(*document, "at", "n"))
    # A set: each of many equal rows may have told of the same repeats within it.
    gone = gone.groupBy(*document).agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    return texts.join(gone, document, "left").select("doc_id", "text", F.coalesce("runs", F.array().cast("array<struct<at:bigint,n:int>>")).alias("runs")).mapInArrow(
        cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
    )


def judge_all(judge):
    """``judge`` for the rows with names, which come first; rows without are repeats."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = []

        def with_keys() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cut = batch.num_rows - batch.column(0).null_count
                if cut:
                    yield batch.slice(0, cut)
                if cut < batch.num_rows:
                    rest.append(batch.slice(cut))
                    break

        yield from judge(with_keys())
        for batch in (*rest, *batches) if rest else ():
            doc, key, at, n = (batch.column(c).to_numpy() for c in (2, 3, 4, 5))
            yield spans(doc, key, at, n, np.zeros(len(doc), bool))

    return judged
