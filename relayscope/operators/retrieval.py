"""Ranked retrieval: exact cosine, conjunctive lexical match, rank fusion, tool selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from relayscope.operators import lexical, nearest
from relayscope.operators.lineage import checkpointed

#: Defaults: candidates of an arm, the fusion's constant, and tools offered above a similarity.
ARM, RRF, TOOLS, FLOOR = 50, 60, 5, 0.25


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dense_topk(chunks: DataFrame, query: Column, k: int = ARM, source: str | None = None) -> DataFrame:
    """id, score of the k chunks nearest to the query, by score and then id; exact, so a filter never leaves too few."""
    rows = chunks if source is None else chunks.where(F.col("source") == source)
    return rows.select("id", cosine(F.col("embedding"), query).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def ranks(arm: DataFrame) -> DataFrame:
    """id, rank of an arm; arms have at most ARM rows, so one window over all of them is small."""
    return arm.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def fused(*arms: DataFrame, constant: int = RRF) -> DataFrame:
    """id, score: the sum of 1 / (constant + rank) over the arms."""
    every = ranks(arms[0])
    for arm in arms[1:]:
        every = every.union(ranks(arm))
    return every.groupBy("id").agg(F.sum(F.lit(1.0) / (F.col("rank") + constant)).alias("score"))


def hybrid_search(chunks: DataFrame, query: Column, index: DataFrame | None = None, terms: Sequence[str] = (), k: int = 10, source: str | None = None) -> DataFrame:
    """id, score of the k best of both arms, or of the dense one alone if no lexical index is given."""
    dense = dense_topk(chunks, query, ARM, source)
    if index is None:
        return dense.limit(k)
    return fused(dense, lexical.sparse_topk(index, terms, ARM, source)).orderBy(F.desc("score"), "id").limit(k)


#: Queries that are sent to all tasks at once, and pairs of vectors that a task gets; parameters.
BLOCK, PAIRS = 4096, 2**28


def batch_topk(candidates: DataFrame, queries: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """query, id, score, rank: the k candidates nearest to each query.

    queries: a stated set (query, q); it goes out in blocks of about BLOCK, whose
    size is what the driver and a task hold, so that the set may be of any size.
    A task multiplies matrices, and of its rows only k a query leave it; see
    ``nearest``. Pairs are as many as rows times queries.
    """
    session = candidates.sparkSession
    kinds = [queries.schema["query"].dataType, candidates.schema["id"].dataType]
    schema = StructType([StructField("query", kinds[0]), StructField("id", kinds[1]), StructField("score", DoubleType())])
    asked = checkpointed(queries.select("query", F.col("q").cast("array<double>").alias("q")), "queries")
    m = asked.count()
    if m == 0:
        return session.createDataFrame([], schema).withColumn("rank", F.lit(1))
    # Written once: each block reads them.
    rows = checkpointed(candidates.select("id", "embedding"), "candidates")
    blocks = max(1, -(-m // BLOCK))
    parts = max(1, -(-rows.count() * min(m, BLOCK) // PAIRS))
    vectors = rows.repartition(parts, "id").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = []
    for number in range(blocks):
        block = (asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number) if blocks > 1 else asked).toArrow().combine_chunks()
        if block.num_rows == 0:
            continue
        near = vectors.mapInArrow(nearest.nearest(*(block.column(c).combine_chunks() for c in ("query", "q")), k, floor), schema)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        # A block's queries don't outlive it.
        out.append(checkpointed(best, "nearest") if blocks > 1 else best)
    return reduce(DataFrame.union, out)


def nested_topk(candidates: DataFrame, queries: DataFrame, sizes: Sequence[int], k: int, floor: float | None = None) -> DataFrame:
    """query, size, id, score, rank: the k nearest of each query in each of the nested catalogs, of which one of a size has the candidates with n (from 0) below it.

    One pass for all sizes: a score is computed once and counts in every catalog
    that has the candidate. Of each task's rows for a query and size only the k
    best leave it, as the rank is a filter that Spark applies before the shuffle.
    """
    blocks, out = max(1, -(-queries.count() // BLOCK)), []
    for number in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number) if blocks > 1 else queries
        pairs = candidates.where(F.col("n") < max(sizes)).join(F.broadcast(block), F.lit(True)).select("query", "id", "n", cosine(F.col("embedding"), F.col("q")).alias("score"))
        if floor is not None:
            pairs = pairs.where(F.col("score") >= floor)
        each = pairs.withColumn("size", F.explode(F.filter(F.array(*map(F.lit, sorted(sizes))), lambda size: size > F.col("n")))).drop("n")
        order = Window.partitionBy("query", "size").orderBy(F.desc("score"), "id")
        out.append(each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return reduce(DataFrame.union, out)


#: Kinds of selection, and the tool that is never deferred.
MODES, LOADED = ("semantic", "full", "native"), "search_docs"


def selected(tools: DataFrame, mode: str, query: Column | None = None, k: int = TOOLS, floor: float = FLOOR, always: Sequence[str] = ()) -> DataFrame:
    """name, deferred of the tools that a prompt gets, by kind of selection; an unknown one raises.

    semantic: those that ``select_tools`` chooses; full: every tool; native: every
    tool, all but LOADED and those that are always offered deferred to the
    provider's own search.
    """
    if mode == "semantic":
        if query is None:
            raise ValueError("semantic selection needs a query")
        return select_tools(tools, query, k, floor, always).select("name", F.lit(False).alias("deferred")).orderBy("name")
    if mode not in MODES:
        raise ValueError(f"no selection {mode!r}; there are {', '.join(MODES)}")
    late = ~F.col("name").isin(LOADED, *always) if mode == "native" else F.lit(False)
    return tools.select("name", late.alias("deferred")).orderBy("name")


def select_tools(tools: DataFrame, query: Column, k: int = TOOLS, floor: float = FLOOR, always: Sequence[str] = ()) -> DataFrame:
    """name, score: the k tools above the floor, then without those that can't be called, then with those always offered.

    A place lost to a tool that can't be called isn't filled again.
    """
    rows = tools.select("name", "dispatchable", cosine(F.col("embedding"), query).alias("score")).where(F.col("score") >= floor)
    chosen = rows.orderBy(F.desc("score"), "name").limit(k).where("dispatchable").select("name", "score")
    if not always:
        return chosen
    extra = tools.where(F.col("name").isin(*always)).select("name", F.lit(None).cast("double").alias("score"))
    return chosen.union(extra.join(chosen, "name", "left_anti"))


def tool_payload(tools: DataFrame, deferred: Sequence[str] | None = None) -> DataFrame:
    """name, payload (JSON) by name; deferred tools carry defer_loading."""
    late = F.lit(False) if deferred is None else F.col("name").isin(*deferred)
    body = F.to_json(F.struct("name", "description", F.when(late, True).alias("defer_loading")))
    return tools.select("name", body.alias("payload")).orderBy("name")
