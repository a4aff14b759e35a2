"""Measures of answers, rankings, tools and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayscope.operators.lineage import checkpointed

#: By how much a metric may fall below its baseline; without a tolerance it is only reported.
TOLERANCES = {"set_f1": 0.02, "recall_at_5": 0.02, "mrr_at_10": 0.02, "tool_jaccard": 0.03, "citation_rate": 0.01}


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def set_f1(found: Column, gold: Column) -> Column:
    """Of sets; 1 for two empty ones, 0 for one empty one."""
    n, m = F.size(F.array_distinct(found)), F.size(F.array_distinct(gold))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(overlap(found, gold) * 2.0 / (n + m))


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    """0 without gold."""
    m = F.size(F.array_distinct(gold))
    return F.when(m == 0, 0.0).otherwise(overlap(F.slice(ranked, 1, k), gold) / m.cast("double"))


def mrr_at(ranked: Column, gold: Column, k: int) -> Column:
    """1 / the place of the first gold one among k."""
    places = F.filter(F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda p: p.isNotNull())
    return F.coalesce(F.lit(1.0) / F.get(places, F.lit(0)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(overlap(a, b) / union.cast("double"))


def exact_match(a: Column, b: Column) -> Column:
    return (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))).cast("double")


def citation_rate(checks: DataFrame, by: str) -> DataFrame:
    """by, rate of the citations that are real and were looked up; turns without citations have none."""
    return checks.groupBy(by).agg(F.avg((F.col("resolved") & F.col("in_result_set")).cast("double")).alias("rate"))


def means(results: DataFrame, metrics: list[str], by: str | None = None) -> DataFrame:
    """Means over those that have a metric; 0 where nobody has it."""
    aggregates = [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics]
    return results.agg(*aggregates) if by is None else results.groupBy(by).agg(F.count("*").alias("n"), *aggregates)


def latency_percentiles(turns: DataFrame) -> DataFrame:
    """p50, p95 as values of the sorted list, at n // 2 and at 0.95 * (n - 1), without interpolation.

    Distinct values are counted and dealt to ranges; the driver adds up the
    ranges' counts, and only the range that holds a place is looked into.
    """
    counted = turns.where("ms is not null").groupBy("ms").agg(F.count("*").alias("n"))
    ranges = checkpointed(counted.repartitionByRange("ms").select("ms", "n", F.spark_partition_id().alias("range")))
    sizes = ranges.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()
    total = sum(r["n"] for r in sizes)

    def at(place: int) -> DataFrame:
        before = 0
        for r in sizes:
            if place < before + r["n"]:
                upto = F.sum("n").over(Window.orderBy("ms")) + before
                return ranges.where(F.col("range") == r["range"]).withColumn("upto", upto).where(F.col("upto") > place).agg(F.min("ms").alias("v"))
            before += r["n"]
        return ranges.agg(F.max("ms").alias("v"))

    return at(total // 2).withColumnRenamed("v", "p50").crossJoin(at(int(0.95 * (total - 1))).withColumnRenamed("v", "p95"))


def weakest(results: DataFrame, n: int = 5) -> DataFrame:
    return results.orderBy("recall", "mrr", "qid").limit(n)


def gate(current: DataFrame, baseline: DataFrame, tolerances: DataFrame) -> DataFrame:
    """metric, failed: whether a metric fell further below its baseline than it may; null if it is only reported."""
    rows = baseline.join(current, "metric", "left").join(tolerances, "metric", "left")
    return rows.select("metric", F.when(F.col("tolerance").isNotNull(), F.coalesce(F.col("value") < F.col("base") - F.col("tolerance"), F.lit(True))).alias("failed"))


def explained(found: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, item, sign: + for what was found and isn't gold, - for gold that wasn't found."""
    both = found.select("qid", "item", F.lit(True).alias("f")).distinct().join(gold.select("qid", "item", F.lit(True).alias("g")).distinct(), ["qid", "item"], "full_outer")
    return both.where("f is null or g is null").select("qid", "item", F.when(F.col("g").isNull(), "+").otherwise("-").alias("sign"))


def separation(pairs: DataFrame) -> DataFrame:
    """gold, other (medians), separation, overlap: the share of others that reach the gold median."""
    m = pairs.agg(F.median(F.when(F.col("is_gold"), F.col("score"))).alias("gold"), F.median(F.when(~F.col("is_gold"), F.col("score"))).alias("other"))
    reach = pairs.where(~F.col("is_gold")).join(F.broadcast(m), F.lit(True)).agg(F.avg((F.col("score") >= F.col("gold")).cast("double")).alias("overlap"))
    return m.crossJoin(reach).select("gold", "other", (F.col("gold") - F.col("other")).alias("separation"), "overlap")


def arm_report(scenarios: DataFrame) -> DataFrame:
    """arm, success_rate, mean_turns (of successes), cost_per_success, total_cost."""
    won = F.col("turns").isNotNull()
    n = F.sum(won.cast("long"))
    return scenarios.groupBy("arm").agg(
        F.avg(won.cast("double")).alias("success_rate"),
        F.avg("turns").alias("mean_turns"),
        (F.sum("cost") / F.nullif(n, F.lit(0))).alias("cost_per_success"),
        F.sum("cost").alias("total_cost"),
    )


def prompt_tokens(text: Column) -> Column:
    """From below, unlike the estimate for memories."""
    return F.floor(F.length(text) / F.lit(3.5).cast("double")).cast("long")


def synthetic_tools(verbs: DataFrame, objects: DataFrame, n: int) -> DataFrame:
    """name, ordinal of n tools verb_object, all objects of the first verb first; smaller n are a prefix.

    verbs, objects: word, place (from 0). An ordinal tells the places of its verb
    and its object, so ordinals are a range that joins both lists; of a name that
    comes twice the first counts. The range is n long, and doubled for as long as
    names that come twice leave too few. Lists that have too few raise.
    """
    of, wide = verbs.count(), objects.count()
    every, m = of * wide, n
    while True:
        numbers = verbs.sparkSession.range(min(m, every)).select(F.col("id").alias("ordinal"), F.floor(F.col("id") / max(wide, 1)).alias("verb_at"), (F.col("id") % max(wide, 1)).alias("object_at"))
        rows = numbers.join(verbs.select(F.col("place").cast("long").alias("verb_at"), "word"), "verb_at").join(objects.select(F.col("place").cast("long").alias("object_at"), F.col("word").alias("object")), "object_at")
        named = rows.groupBy(F.concat_ws("_", "word", "object").alias("name")).agg(F.min("ordinal").alias("ordinal"))
        if (have := named.count()) >= n:
            return named.orderBy("ordinal").limit(n)
        if m >= every:
            raise ValueError(f"{n} tools of {have}")
        m *= 2
