"""Exact top-k inner products by an index of pivots and distances.

Vectors are lifted by one coordinate to a common norm, so that the largest inner
products are the smallest distances. Each vector is keyed by its nearest pivot
and its distance to it; Spark sorts all of them by that key and cuts them into
annuli of a pivot. By the triangle inequality, what a query finds in an annulus
is no nearer than the annulus is to the query's own distance from the pivot. So a
query looks into the annuli of its nearest pivot in the order of their gaps until
they have k vectors, then expands to all annuli within half of the distance of its
k-th best, and then to those within all of it: there it stops, and what is beyond
that bound is not read for it. A task gets
one annulus and one block of the queries that look into it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayscope.llm.shared import written

#: Pivots, the vectors that they are fitted on, vectors of an annulus, and queries that meet an annulus at once.
PIVOTS, SAMPLE, ANNULUS, BLOCK = 64, 4096, 512, 1024
VECTORS = "row long, vec_id long, is_query boolean, dim int, norm long, v binary"
KEYED = "row long, vec_id long, is_query boolean, norm long, v binary, pivot int, distance double, far array<double>"
RINGS = "ring long, pivot int, n int, inner_edge double, outer_edge double, rows binary, ids binary, vectors binary"
HITS = "query long, row long, vec_id long, score long"


def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(256 * x) of the vectors that take part; row numbers them over the whole table."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids, queries, lists = batch.columns
        flat = lists.flatten().cast(pa.float64())
        values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
        sizes = np.where(lists.is_null(), 0, pc.list_value_length(lists).fill_null(0)).astype(np.int64)
        ends = np.cumsum(sizes)
        out = []
        for i in range(batch.num_rows):
            x = values[ends[i] - sizes[i] : ends[i]]
            if not lists[i].is_valid or not np.isfinite(x).all():
                continue
            x = np.floor(256 * x)
            if len(x) and np.abs(x).max() > np.sqrt(2.0**62 / len(x)):
                raise OverflowError(f"vector {ids[i]} is so large that a score may not fit into 64 bits")
            x = x.astype("<i8")
            out.append((row, ids[i].as_py(), queries[i].as_py(), len(x), int(x @ x), x.tobytes()))
            row += 1
        if out:
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary()]
            names = ["row", "vec_id", "is_query", "dim", "norm", "v"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def lifted(v: np.ndarray, norm: np.ndarray, top: int) -> np.ndarray:
    """One more coordinate, with which all norms are ``top``."""
    return np.c_[v.astype(float), np.sqrt(np.maximum(0, top - norm.astype(float)))]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def fitted(sample: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Pivots: means of the sample's vectors, by a few rounds of k-means; of few vectors few, so that most have several."""
    pivots = sample[np.linspace(0, len(sample) - 1, min(PIVOTS, int(np.ceil(np.sqrt(len(sample)))))).astype(int)]
    for _ in range(rounds):
        near = distances(sample, pivots).argmin(1)
        pivots = np.array([sample[near == p].mean(0) if (near == p).any() else pivots[p] for p in range(len(pivots))])
    return pivots


def keyed(dim: int, pivots: np.ndarray, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each vector's nearest pivot and its distance; of a query (it lies in the plane of the lifted ones) its distances to all pivots."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), dim)
            far = distances(lifted(v, batch.column("norm").to_numpy(), top), pivots)
            near = far.argmin(1)
            asks = batch.column("is_query").to_numpy(zero_copy_only=False)
            own = list(distances(np.c_[v[asks].astype(float), np.zeros(asks.sum())], pivots))
            lists = [own.pop(0).tolist() if q else None for q in asks]
            columns = [batch.column(c) for c in ("row", "vec_id", "is_query", "norm", "v")]
            extra = [pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near]), pa.array(lists, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=["row", "vec_id", "is_query", "norm", "v", "pivot", "distance", "far"])

    return key


def cut_into_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Annuli of up to ANNULUS vectors of one pivot, from rows sorted by pivot and distance."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        pivot, distance = batch.column("pivot").to_numpy(), batch.column("distance").to_numpy()
        edges = np.flatnonzero(np.diff(pivot)) + 1
        out = []
        for lo, hi in zip([0, *edges], [*edges, len(pivot)], strict=True):
            for i in range(lo, hi, ANNULUS):
                part = batch.slice(i, min(ANNULUS, hi - i))
                numbers = (part.column(c).to_numpy().astype("<i8").tobytes() for c in ("row", "vec_id"))
                d = distance[i : i + len(part)]
                out.append((number, int(pivot[i]), len(d), float(d.min()), float(d.max()), *numbers, b"".join(part.column("v").to_pylist())))
                number += 1
        if out:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            names = ["ring", "pivot", "n", "inner_edge", "outer_edge", "rows", "ids", "vectors"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def exact_product(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; floating point where that is exact."""
    if queries.size and vectors.size and float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1] < 2**53:
        return (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
    return queries @ vectors.T


def searcher(dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of one annulus for each query of a block; ties go to the smaller vec_id."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, rows, ids, vectors in zip(*(batch.column(c) for c in ("asked", "rows", "ids", "vectors")), strict=True):
                own, names = (np.frombuffer(x.as_buffer(), "<i8") for x in (rows, ids))
                query = asked.values.field("query").to_numpy()
                q = np.frombuffer(b"".join(asked.values.field("v").to_pylist()), "<i8").reshape(len(query), dim)
                found = exact_product(q, np.frombuffer(vectors.as_buffer(), "<i8").reshape(len(own), dim))
                itself = query[:, None] == own
                # The order of Python's whole numbers where floating point isn't exact.
                worse = -found.astype(np.float64 if np.abs(found[~itself]).max(initial=0) < 2**53 else object)
                worse[itself] = 0
                order = np.array([np.lexsort((names, x, mine)) for x, mine in zip(worse, itself, strict=True)])[:, :k]
                real = ~np.take_along_axis(itself, order, 1)
                at = np.broadcast_to(query[:, None], order.shape)[real]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[order][real]), pa.array(names[order][real]), pa.array(np.take_along_axis(found, order, 1)[real])], names=["query", "row", "vec_id", "score"])

    return searched


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    vectors: vec_id and embedding; every row for which ``is_query`` holds is a
    query, against every row but itself. Components x count as floor(256 * x).
    Ties go to the smaller vec_id. Vectors that are null or hold null or
    non-finite components take no part; one so large that a score could pass 64
    bits raises. Vectors of unequal lengths don't meet. Repeated rows are rows of
    their own; a row with a null vec_id takes no part. Fewer than k candidates
    give fewer rows; an empty table gives an empty result.

    The pivots are fitted on the SAMPLE vectors with the smallest hashes of
    vec_id; the index and the search cover all. The driver gets those, and one
    row for each length of vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null").select("vec_id", F.coalesce(is_query, F.lit(False)).alias("is_query"), "embedding")
    table = written(rows.mapInArrow(quantised, VECTORS), "vectors")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    out = None
    for dim, top in [(r["dim"], r["top"]) for r in table.groupBy("dim").agg(F.max("norm").alias("top")).orderBy("dim").collect()]:
        mine = table.where(F.col("dim") == dim)
        sample = mine.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE).toPandas()
        pivots = fitted(lifted(np.frombuffer(b"".join(sample.v), "<i8").reshape(len(sample), dim), sample.norm.to_numpy(), top))
        index = written(mine.mapInArrow(keyed(dim, pivots, top), KEYED), "index")
        dealt = index.select("row", "vec_id", "v", "pivot", "distance").repartitionByRange("pivot", "distance", "row").sortWithinPartitions("pivot", "distance", "row")
        rings = written(dealt.mapInArrow(cut_into_rings, RINGS), "rings")
        queries = index.where("is_query").select(F.col("row").alias("query"), "v", "norm", "far", F.array_position("far", F.array_min("far")).cast("int").alias("home"))
        hits = expanded(queries, rings, dim, top, k)
        ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = index.where("is_query").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
        found = ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def expanded(queries: DataFrame, rings: DataFrame, dim: int, top: int, k: int) -> DataFrame:
    """The hits of all annuli that may hold one of a query's k best, each once."""
    blocks = max(1, -(-queries.count() // BLOCK))
    edges = rings.select("ring", "pivot", "n", "inner_edge", "outer_edge")
    slack = 1e-6 * float(np.sqrt(top)) + 1e-9
    each = queries.select("query", "norm", "home", F.posexplode("far").alias("pivot", "d"))
    gap = F.greatest(F.lit(0.0), F.col("inner_edge") - F.col("d"), F.col("d") - F.col("outer_edge"))
    kth = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    hits, looked = None, None
    for reach in (0.0, 0.5, 1.0):
        if hits is None:
            # Of its nearest pivot's annuli those that a query lies in or next to, until they have k others.
            near = each.where(F.col("pivot") == F.col("home") - 1).join(edges, "pivot").withColumn("gap", gap)
            before = F.coalesce(F.sum("n").over(Window.partitionBy("query").orderBy("gap", "ring").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            visits = near.withColumn("before", before).where(F.col("before") <= k)
        else:
            least = hits.withColumn("place", F.row_number().over(kth)).where(F.col("place") == k).select("query", F.col("score").alias("least"))
            bound = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.lit(float(top)) - 2.0 * F.col("least").cast("double"))) + slack
            # Without k hits there is no bound yet.
            look = each.join(least, "query", "left").withColumn("upto", F.when(F.col("least").isNull(), float("inf")).otherwise(bound) * reach)
            visits = look.join(edges, "pivot").where(gap <= F.col("upto")).join(looked, ["query", "ring"], "left_anti")
        visits = written(visits.select("query", "ring"), "visits")
        looked = visits if looked is None else looked.union(visits)
        one = visits.join(queries.select("query", "v"), "query")
        asked = one.groupBy("ring", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query", "v")).alias("asked"))
        found = asked.join(rings, "ring").select("asked", "rows", "ids", "vectors").mapInArrow(searcher(dim, k), HITS)
        every = found if hits is None else hits.union(found)
        hits = written(every.withColumn("place", F.row_number().over(kth)).where(F.col("place") <= k).drop("place"), "hits")
    return hits
