"""Near-duplicate documents by circulant MinHash.

Two permutations make all coordinates of a signature: the first scatters the
shingles over a circle of 2 ** 32 places, the second ranks the places, and the
k-th coordinate is the least rank after the circle is turned by k places.
Signatures are cut into bands; texts that agree on a band are compared by exact
Jaccard similarity of their shingle sets.

Equal sets are one class from the start. Within a bucket of a band not all pairs
are compared: first each member with the one that has most company. What then lies in
buckets of several components is compared by an exact prefix join: with the
shingles in one order, rarest first, two sets that are similar enough have a
first shingle in common whose places in both leave enough behind them. Only
pairs of different components that meet in such a shingle are compared in full,
so that after it every other pair of a bucket is in one component or no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayscope.llm.components import connected_components
from relayscope.llm.shared import row_keys, written
from relayscope.llm.words import mixed, shingle_sets, word_hashes

V = np.uint32
#: Rows of a band; with so few, a pair at the threshold is all but sure to share a band.
ROWS = 4
#: Bits of the marks that bound what only one of two sets has.
MARKS = 2048
#: Sets of a block.
SETS = 256
#: The chance that a pair at the threshold shares no band is below this.
MISSED = 1e-7


def bands_for(similarity: float) -> int:
    """Bands of ROWS rows that meet MISSED at ``similarity``."""
    return int(np.ceil(np.log(MISSED) / np.log1p(-(similarity**ROWS))))


def ranked(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit integers."""
    x = (x ^ (x >> V(16))) * V(0x85EBCA6B)
    x = (x ^ (x >> V(13))) * V(0xC2B2AE35)
    return x ^ (x >> V(16))


def signatures(sets: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of coordinates for each set that isn't empty."""
    places = (mixed(sets) >> np.uint64(32)).astype(V)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), coordinates), V)
    if len(starts):
        for k in range(coordinates):
            out[:, k] = np.minimum.reduceat(ranked(places - V(k)), starts)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One key for each signature and band."""
    keys = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + signature[:, k])
        keys[:, b] = h
    return keys


def set_digests(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set; an empty set has zeros."""
    one, two = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    if len(sets):
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        one[sizes > 0] = np.add.reduceat(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), starts)
        two[sizes > 0] = np.bitwise_xor.reduceat(mixed(sets * np.uint64(0x2545F4914F6CDD1D)), starts)
    return one, two


def sketcher(size: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, text_keys, texts = batch.columns
            for lo, hi, words, counts in word_hashes(texts):
                sets, sizes = shingle_sets(words, counts, size)
                one, two = set_digests(sets, sizes)
                keys = band_keys(signatures(sets, sizes, bands * ROWS), bands)
                ends = np.cumsum(np.where(sizes > 0, bands, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(lo, hi - lo), text_keys.slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists],
                    names=["doc", "text_key", "n_shingles", "d1", "d2", "bands"],
                )

    return sketched


def set_maker(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for lo, hi, words, counts in word_hashes(texts):
                sets, sizes = shingle_sets(words, counts, size)
                at = np.r_[0, np.cumsum(sizes) * 8].astype(np.int64)
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(sets.tobytes())])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), column.cast(pa.binary())], names=["vertex", "shingles"])

    return made


def linker(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs with both sets, those with 100 * intersection >= percent * union."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, twos = batch.column("one"), batch.column("two")
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (ones, twos))
                both = np.concatenate((x, y))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    return linked


def near_groups(documents: DataFrame, shingle: int, percent: int, with_nulls: bool) -> DataFrame:
    """doc, text_key, n_shingles, first_doc, first_key of each row of ``documents``; see ``row_keys``.

    first_doc and first_key: the smallest row that links reach, itself included.
    Rows are known by their doc_id and text, so that a doc_id may have several
    texts. with_nulls: rows with a null doc_id, the smallest of all, take part;
    else they are linked with nothing. Nor are texts without words.
    """
    bands, row = bands_for(percent / 100), ["doc", "text_key"]
    texts = row_keys(documents).select(*row, "text")
    sketches = written(texts.mapInArrow(sketcher(shingle, bands), "doc long, text_key long, n_shingles long, d1 long, d2 long, bands array<long>"), "sketches")
    sound = sketches.where("n_shingles > 0") if with_nulls else sketches.where("n_shingles > 0 and text_key >= 0")
    of_set = ["d1", "d2", "n_shingles"]
    least = sound.groupBy(*of_set).agg(F.min(F.struct(*row, "bands")).alias("m"))
    classes = written(least.select(*of_set, F.col("m.doc").alias("doc"), F.col("m.text_key").alias("text_key"), F.col("m.bands").alias("bands"), F.monotonically_increasing_id().alias("vertex")), "classes")
    spread = classes.select("vertex", "n_shingles", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    buckets = written(spread.join(shared, "band"), "buckets")
    involved = classes.join(buckets.select("vertex").distinct(), "vertex", "left_semi").select(*row, "vertex")
    sets = written(texts.join(involved, row).dropDuplicates(row).select("vertex", "text").mapInArrow(set_maker(shingle), "vertex long, shingles binary"), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those that are similar enough."""
        full = pairs.join(sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("two")), "b").join(
            sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("one")), "a"
        )
        return written(full.select("a", "b", "one", "two").mapInArrow(linker(percent), "a long, b long"), "links")

    n, pivot_n = F.col("n_shingles"), F.col("pivot.n_shingles")
    # A bucket's pivot is the member with most company in all of its buckets.
    company = buckets.groupBy("vertex").agg(F.sum("members").alias("company"))
    pivots = buckets.join(company, "vertex").groupBy("band").agg(F.max(F.struct("company", "vertex", "n_shingles")).alias("pivot"))
    stars = buckets.join(pivots, "band").where((F.col("vertex") != F.col("pivot.vertex")) & (F.least(n, pivot_n) * 100 >= F.greatest(n, pivot_n) * percent))
    edges = links(stars.select(F.col("pivot.vertex").alias("a"), F.col("vertex").alias("b")).distinct())
    components = written(connected_components(edges), "components")
    more = links(candidates(buckets.where("members > 2"), components, sets, percent))
    if not more.isEmpty():
        components = connected_components(edges.union(more))
    # The smallest row of a component, by way of the classes.
    placed = classes.select(*of_set, *row, "vertex").join(components.withColumnRenamed("id", "vertex"), "vertex", "left")
    placed = placed.withColumn("component", F.coalesce("component", "vertex"))
    firsts = placed.groupBy("component").agg(F.min(F.struct(*row)).alias("first"))
    named = placed.join(firsts, "component").select(*of_set, "first")
    rows = sketches.select(*row, *of_set).join(named, of_set, "left")
    alone = F.col("first").isNull() if with_nulls else F.col("first").isNull() | (F.col("text_key") < 0)
    first = F.when(alone, F.struct(*row)).otherwise(F.col("first"))
    return rows.select(*row, "n_shingles", first["doc"].alias("first_doc"), first["text_key"].alias("first_key"))


def candidates(buckets: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of different components, in buckets (band, vertex) of several, that may still be links."""
    parts = components.groupBy("component").agg(F.count("*").alias("part"))
    placed = buckets.select("band", "vertex", "n_shingles").join(components.withColumnRenamed("id", "vertex"), "vertex", "left")
    placed = placed.withColumn("component", F.coalesce("component", "vertex"))
    several = placed.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2")
    members = placed.join(several, "band", "left_semi").select("vertex", "n_shingles", "component").distinct()
    members = members.join(parts, "component", "left").withColumn("part", F.coalesce("part", F.lit(1)))
    members = written(members.join(sets.mapInArrow(marked, "vertex long, marks binary"), "vertex"), "members")
    each = sets.join(members.select("vertex"), "vertex", "left_semi").mapInArrow(exploded, "vertex long, shingle long")
    common = each.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1")
    # What no other set has comes first in the order, as it is rarest.
    order = each.join(common, "shingle").groupBy("vertex").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("order"))
    alone = F.col("n_shingles") - F.size("order")
    within = F.floor(F.col("n_shingles") * (100 - percent) / 100).cast("int") + 1 - alone
    prefixes = order.join(members.drop("marks"), "vertex").select(
        "vertex", "n_shingles", "component", "part", alone.alias("alone"), F.posexplode(F.slice("order", F.lit(1), F.greatest(within, F.lit(0)).cast("int"))).alias("at", "s")
    )
    prefixes = prefixes.select("vertex", "n_shingles", "component", "part", F.col("s.shingle").alias("shingle"), (F.col("n_shingles") - F.col("alone") - F.col("at")).alias("behind"))
    prefixes = written(prefixes, "prefixes")
    # Of a shingle's sets, those outside its largest component meet all the others, in blocks.
    largest = prefixes.groupBy("shingle").agg(
        F.max(F.struct("part", "component")).alias("main"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.ceil(F.count("*") / SETS).alias("blocks")
    )
    there = prefixes.join(largest.where("c1 <> c2").select("shingle", F.col("main.component").alias("main"), "blocks"), "shingle").join(members.select("vertex", "marks"), "vertex")
    there = written(there.withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks"))).drop("part", "alone"), "there")
    one = F.struct("vertex", "n_shingles", "component", "behind", "marks")
    blocks = there.groupBy("shingle", "main", "block").agg(F.collect_list(one).alias("sets"))
    outside = there.where("component <> main").groupBy("shingle", "block").agg(F.collect_list(one).alias("outside")).select("shingle", "outside")
    return blocks.select("shingle", "main", "sets").join(outside, "shingle").select("main", "sets", "outside").mapInArrow(comparer(percent), "a long, b long").distinct()


def comparer(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of two blocks of sets that have a shingle in common: the pairs of different components that may be links."""

    def columns(block: pa.StructScalar) -> list[np.ndarray]:
        rows = block.values
        numbers = [rows.field(c).to_numpy() for c in ("vertex", "n_shingles", "component", "behind")]
        return [*numbers, np.frombuffer(b"".join(rows.field("marks").to_pylist()), np.uint64).reshape(len(rows), -1)]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for main, sets, outside in zip(*(batch.column(c) for c in ("main", "sets", "outside")), strict=True):
                v, n, c, behind, marks = columns(sets)
                p, np_, cp, bp, pm = columns(outside)
                both = n + np_[:, None]
                # The shingles before the first common one are in one of the sets only.
                go = (c != cp[:, None]) & ((c == main.as_py()) | (v < p[:, None])) & ((both - behind - bp[:, None]) * (100 + percent) <= both * (100 - percent))
                go &= np.minimum(behind, bp[:, None]) * (100 + percent) >= both * percent
                x, y = np.nonzero(go)
                for i in range(0, len(x), 1 << 14):
                    xs, ys = x[i : i + (1 << 14)], y[i : i + (1 << 14)]
                    # So is the shingle of a mark that only one has.
                    apart = np.bitwise_count(pm[xs] ^ marks[ys]).sum(1, dtype=np.int64)
                    near = apart * (100 + percent) <= both[xs, ys] * (100 - percent)
                    out.append(np.stack((p[xs[near]], v[ys[near]])))
            ends = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            ends = np.unique(np.sort(ends, axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

    return compared


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MARKS bits for each set, those at its shingles modulo MARKS."""
    for batch in batches:
        out = np.zeros((batch.num_rows, MARKS), np.uint8)
        for i, x in enumerate(batch.column("shingles")):
            out[i, (np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(MARKS)).astype(np.int64)] = 1
        words = np.packbits(out, axis=1, bitorder="little")
        yield pa.RecordBatch.from_arrays([batch.column("vertex"), pa.array([w.tobytes() for w in words], pa.binary())], names=["vertex", "marks"])


def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set."""
    for batch in batches:
        vertices, sets = batch.column("vertex").to_numpy(), batch.column("shingles")
        for i in range(batch.num_rows):
            shingles = np.frombuffer(sets[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shingles), vertices[i])), pa.array(shingles)], names=["vertex", "shingle"])


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``documents``.

    ASCII letters are lower-cased; words are runs without ASCII white space; a
    document's set holds its distinct shingles of ``shingle`` words, or its
    whole sequence if that is shorter. Documents are linked from a Jaccard
    similarity of ``percent`` / 100; component_id is the smallest doc_id that
    links reach, and the document with that doc_id is kept. Null or wordless
    texts have no shingles, no links, and are kept. Rows of one doc_id with
    different texts are documents of their own, each with its own links; equal
    rows share one fate. A row with a null doc_id is linked with nothing, and
    kept. An empty table gives an empty result; other columns are not read.
    """
    groups = near_groups(documents, shingle, percent, with_nulls=False)
    no_id = F.col("text_key") < 0
    doc_id, first = F.when(~no_id, F.col("doc")), F.when(~no_id, F.col("first_doc"))
    return groups.select(doc_id.alias("doc_id"), "n_shingles", first.alias("component_id"), (no_id | (F.col("doc") == F.col("first_doc"))).alias("kept"))


def rows_to_drop(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc, text_key (see ``row_keys``) of the rows that ``near_duplicates`` would drop, each once; here null doc_ids, the smallest, take part, and of each group one row stays."""
    groups = near_groups(documents, shingle, percent, with_nulls=True)
    return groups.where("doc <> first_doc or text_key <> first_key").select("doc", "text_key").distinct()
