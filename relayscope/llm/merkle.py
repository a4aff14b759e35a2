"""A Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and proofs.

Every level is a sibling-shift self-join. A node knows its place in its tree;
its slot is its place modulo the fan-out. Slot-zero rows compute the places of
their siblings by slot offsets, equijoin the level's nodes with those, and emit
the parents. A level is kept as its runs (a row for each parent, at most a
fan-out of digests); a node finds its own siblings by its offset to slot zero.

Places come from a range sort, so that a source with a third of all rows is
spread like any other. Texts are read once, for the leaves' digests; nothing of
them is shuffled. Paths are joined from the root down and meet the leaves last,
one row for each leaf and each run of leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayscope.llm.shared import dropped, written

FAN_OUT = 16
#: The tree over the sources; the others' names begin with 0 (no source) or 1.
TOP = ""


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """What a leaf holds of a field: its UTF-8 size and itself, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The digest of a row of documents, with another text if given."""
    return digest(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(F.col("text") if text is None else text))


def lowered(text: Column) -> Column:
    """``text`` with its A-Z in lower case; nothing else changes."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` (a written table) with ``place`` from 0 within each tree, and ``n``, the tree's size.

    Rows are range sorted; the place is that within the sorted part, after the
    tree's rows in earlier parts. A tree lies in neighbouring parts, so the table
    of (part, tree) has no more rows than parts and trees together.
    """
    numbered = F.monotonically_increasing_id()
    by = [F.col(tree), *(F.col(c).asc_nulls_first() for c in order)]
    parts = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row", numbered), "merkle_sorted")
    part = F.shiftright("row", 33)
    spans = parts.groupBy(F.col(tree).alias("span_tree"), part.alias("span_part")).agg(F.min("row").alias("first"), F.count("*").alias("size"))
    tree_spans = Window.partitionBy("span_tree")
    earlier = tree_spans.orderBy("span_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("n", F.sum("size").over(tree_spans)).withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    joined = parts.join(spans, (F.col(tree) == F.col("span_tree")) & (part == F.col("span_part")))
    return joined.withColumn("place", F.col("row") - F.col("first") + F.col("before")).drop("row", "span_tree", "span_part", "first", "size", "before")


def parents(nodes: DataFrame, fan_out: int) -> DataFrame:
    """The runs of a level of ``nodes`` (tree, place, n, digest): tree, place of the parent, n of its level, members.

    Slot-zero rows equijoin the nodes at the places of their siblings.
    """
    slot = F.pmod("place", F.lit(fan_out))
    heads = nodes.where(slot == 0)
    last = F.least(F.col("place") + fan_out, F.col("n")) - 1
    wanted = heads.where(F.col("place") < last).select(F.col("tree").alias("of"), F.col("place").alias("head"), F.explode(F.sequence(F.col("place") + 1, last)).alias("at"))
    siblings = nodes.where(slot != 0).join(wanted, (F.col("tree") == F.col("of")) & (F.col("place") == F.col("at")))
    # At most a fan-out of rows meet in a group, whatever the tree.
    found = heads.select("tree", F.col("place").alias("head"), "place", "n", "digest").unionByName(siblings.select("tree", "head", "place", "n", "digest"))
    runs = found.groupBy("tree", "head", "n").agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("m"))
    return runs.select("tree", F.floor(F.col("head") / fan_out).alias("place"), F.ceil(F.col("n") / fan_out).alias("n"), F.col("m.digest").alias("members"))


def grown(nodes: DataFrame, fan_out: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level above ``nodes``, and tree, digest of the trees' last nodes."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], nodes.where("n = 1").select("tree", "digest")
    while most > 1:
        runs = written(parents(nodes.where("n > 1"), fan_out), name)
        levels.append(runs)
        nodes = runs.select("tree", "place", "n", F.sha2(F.concat_ws("", "members"), 256).alias("digest"))
        tops = tops.unionByName(nodes.where("n = 1").select("tree", "digest"))
        most = -(-most // fan_out)
    return levels, tops


def step(fan_out: int, place: str) -> Column:
    """A node's siblings in its run, as texts: those before it and those after it."""
    slot = F.pmod(F.col(place), F.lit(fan_out)).cast("int")
    join = lambda part: F.concat_ws("", part)
    return F.struct(join(F.slice("members", F.lit(1), slot)).alias("before"), join(F.slice("members", slot + 2, F.lit(fan_out))).alias("after"))


def paths(levels: list[DataFrame], above: DataFrame, fan_out: int) -> DataFrame:
    """tree, place, members, path of the runs over the lowest nodes; path leads from their parent to the root.

    ``above`` has tree and path of each tree's last node. A tree without levels, of a single node, has no rows.
    """
    out = None
    for runs in reversed(levels):
        last = runs.where("n = 1").join(above.withColumnRenamed("tree", "of"), F.col("tree") == F.col("of")).select("tree", "place", "members", "path")
        if out is not None:
            upper = out.select(F.col("tree").alias("of"), F.col("place").alias("up"), F.col("members").alias("upper"), F.col("path").alias("rest"))
            inner = runs.where("n > 1").join(upper, (F.col("tree") == F.col("of")) & (F.floor(F.col("place") / fan_out) == F.col("up")))
            own = inner.withColumn("kept", F.col("members")).withColumn("members", F.col("upper"))
            last = last.unionByName(own.select("tree", "place", F.concat(F.array(step(fan_out, "place")), "rest").alias("path"), F.col("kept").alias("members")))
        out = last
    return out


PATH = "array<struct<before:string,after:string>>"


def manifest(documents: DataFrame, tampered: Column | None = None, altered: Column | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of ``documents``.

    A leaf is the digest of doc_id, source, lang, n_chars and text, each with its
    size, a dash for null. Per source leaves ascend by doc_id (null first) and,
    among rows that share it, by digest; equal rows are leaves of their own.
    ``fan_out`` consecutive nodes at a time are digested until one is left, the
    subroot; a lone leaf is one. Subroots by source (null first) give root alike.
    proof_sha256 digests the siblings on a row's way to the root. folded_root is
    computed upwards from the leaf and those siblings, where ``tampered`` holds
    from the leaf of the text ``altered``; verified says if it is the root. An
    empty table gives an empty result; other columns are not read.
    """
    spark = documents.sparkSession
    name = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(altered))
    leaves = written(documents.select("doc_id", name.alias("tree"), leaf().alias("digest"), other.alias("other")), "merkle_leaves")
    nodes = written(placed(leaves, "tree", "doc_id", "digest", "other"), "merkle_nodes")
    levels, subroots = grown(nodes, fan_out, "merkle_runs")
    subroots = written(subroots.select(F.lit(TOP).alias("top"), F.col("tree").alias("source_tree"), "digest"), "merkle_subroots")
    sources = written(placed(subroots, "top", "source_tree").withColumnRenamed("top", "tree"), "merkle_sources")
    top_levels, roots = grown(sources, fan_out, "merkle_top_runs")
    root = roots.first()
    if root is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    # What is above each source's last node.
    nothing = F.expr(f"CAST(array() AS {PATH})")
    if top_levels:
        top = paths(top_levels, spark.range(1).select(F.lit(TOP).alias("tree"), nothing.alias("path")), fan_out)
        at = top.select(F.col("place").alias("up"), "members", "path")
        over = sources.join(at, F.floor(F.col("place") / fan_out) == F.col("up")).withColumn("path", F.concat(F.array(step(fan_out, "place")), "path"))
    else:
        over = sources.withColumn("path", nothing)
    over = over.select(F.col("source_tree").alias("tree"), "digest", "path")
    above = written(over, "merkle_above")
    if levels:
        low = written(paths(levels, above.select("tree", "path"), fan_out), "merkle_paths").withColumnsRenamed({"tree": "of", "place": "up"})
        inner = nodes.where("n > 1").join(low, (F.col("tree") == F.col("of")) & (F.floor(F.col("place") / fan_out) == F.col("up")))
        inner = inner.select("doc_id", "tree", "digest", "other", F.concat(F.array(step(fan_out, "place")), "path").alias("path"))
        lone = nodes.where("n = 1").join(above.select(F.col("tree").alias("of"), "path"), F.col("tree") == F.col("of")).select(*inner.columns)
        rows = inner.unionByName(lone)
    else:
        rows = nodes.join(above.select(F.col("tree").alias("of"), "path"), F.col("tree") == F.col("of")).select("doc_id", "tree", "digest", "other", "path")
    dropped(leaves, subroots)
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(s["before"], s["after"]))), 256)
    folded = F.aggregate("path", F.coalesce("other", "digest"), lambda under, s: F.sha2(F.concat(s["before"], under, s["after"]), 256))
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), "tree", proof.alias("proof_sha256"), folded.alias("folded_root"))
    ends = above.select(F.col("tree").alias("of"), F.col("digest").alias("subroot"))
    rows = rows.join(ends, F.col("tree") == F.col("of"))
    whole = F.lit(root["digest"])
    return rows.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))
