"""Checks of a question set, sweeps of a catalog, and reports of consolidation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayscope.operators import metrics, retrieval

CLASSES = range(1, 7)
#: The last class of questions that have an exact answer.
EXACT = 4


def gold_errors(questions: DataFrame, known: DataFrame, pin: Column, floor: Column, methods: Mapping[str, Sequence[str]]) -> DataFrame:
    """qid, error for each rule that a question of a set breaks.

    questions: place (in the set), qid, class, question, gold_tools, as_of,
    method and args (a map of names to text) of its query, gold (ids of chunks)
    and points (of its answer). ``methods`` names the arguments that each method
    takes. Every one needs an id of its own, a class, a text, tools, and a time
    between the facts' floor, if it is exact, and the pin. Exact classes need a
    query, the others chunks that there are, and points. After an unknown class,
    a missing time, query or method nothing more is said of a question.
    """
    missing = lambda text: F.coalesce(F.trim(text), F.lit("")) == ""
    none = lambda items: F.coalesce(F.size(items), F.lit(0)) <= 0
    day = lambda at: F.date_format(at, "yyyy-MM-dd")
    exact = F.col("class") <= EXACT
    table = F.create_map(*(x for m, names in methods.items() for x in (F.lit(m), F.array(*map(F.lit, names)).cast("array<string>"))))
    unknown = F.array_sort(F.array_except(F.map_keys("args"), F.try_element_at(table, F.col("method"))))
    bad_class = F.col("class").isNull() | ~F.col("class").isin(*CLASSES)
    timed = ~bad_class & F.col("as_of").isNotNull()
    asked = timed & exact & F.col("method").isin(*methods)
    bound = lambda key: F.try_element_at("args", F.lit(key)).try_cast("timestamp_ntz")
    rules = [
        F.when(bad_class, F.concat(F.lit("class must be 1-6, not "), F.coalesce(F.col("class").cast("string"), F.lit("none")))),
        F.when(~bad_class & missing(F.col("question")), "empty question"),
        F.when(~bad_class & none("gold_tools"), "no gold tools"),
        F.when(~bad_class & F.col("as_of").isNull(), "no as_of"),
        F.when(timed & (F.col("as_of") > pin), F.concat(F.lit("as_of "), day("as_of"), F.lit(" is after the pin"))),
        F.when(timed & exact & F.col("method").isNull(), "no query"),
        F.when(timed & exact & ~F.col("method").isin(*methods), F.concat(F.lit("unknown method "), "method")),
        F.when(asked & (F.size(unknown) > 0), F.concat("method", F.lit(" takes no "), F.array_join(unknown, ", "))),
        F.when(asked & (F.col("as_of") < floor), F.concat(F.lit("as_of "), day("as_of"), F.lit(" is before the floor"))),
        *(F.when(asked & (bound(k) < floor), F.concat(F.lit(f"{k} "), day(bound(k)), F.lit(" is before the floor"))) for k in ("since", "until")),
        F.when(timed & ~exact & none("gold"), "no gold"),
        F.when(timed & ~exact & none("points"), "no points"),
    ]
    qid = F.coalesce(F.col("qid").cast("string"), F.lit("<no id>")).alias("qid")
    broken = questions.select(qid, F.explode(F.array_compact(F.array(*rules))).alias("error"))
    repeated = questions.groupBy(qid).agg(F.count("*").alias("n")).where("n > 1").select("qid", F.lit("repeated id"))
    chunks = questions.where(timed & ~exact).select(qid, F.explode("gold").alias("id")).join(known, "id", "left_anti").select("qid", F.concat(F.lit("no chunk "), F.col("id").cast("string")))
    return reduce(DataFrame.union, (broken, repeated, chunks))


def sweep_point(tools: DataFrame, questions: DataFrame, gold: DataFrame, k: int = retrieval.TOOLS, floor: float = retrieval.FLOOR) -> DataFrame:
    """recall, jaccard, offered, crowd_out: over questions, of the tools that similarity selects.

    tools: id, embedding, synthetic; those lose their place after the choice.
    crowd_out: the share of places that they took. questions: query, q (vector),
    a benchmark's; gold: query, id, or topic, id, which all questions of a topic
    have in common and which isn't written out for each. Without gold, recall is
    1. Sets are compared by their sizes; only what is chosen looks up whether it
    is gold.
    """
    by = "topic" if "topic" in gold.columns else "query"
    asked = questions.select("query", *(["topic"] if by == "topic" else []))
    wanted = gold.where(F.col("id").isNotNull()).select(by, "id").distinct()
    chosen = retrieval.batch_topk(tools, questions, k, floor).join(tools.select("id", "synthetic"), "id")
    if by == "topic":
        chosen = chosen.join(asked.distinct(), "query")
    told = chosen.join(wanted.withColumn("wanted", F.lit(True)), [by, "id"], "left")
    own = F.when(~F.col("synthetic"), F.col("id"))
    found = told.groupBy("query").agg(F.size(F.collect_set(own)).alias("f"), F.size(F.collect_set(F.when(F.col("wanted"), own))).alias("both"), F.count("*").alias("places"), F.count_if("synthetic").alias("lost"))
    rows = asked.join(found, "query", "left").join(wanted.groupBy(by).agg(F.count("*").alias("g")), by, "left")
    rows = rows.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("f", "both", "g")), "places", "lost")
    recall = F.when(F.col("g") == 0, 1.0).otherwise(F.col("both") / F.nullif("g", F.lit(0)))
    union = F.col("f") + F.col("g") - F.col("both")
    jaccard = F.when(union == 0, 1.0).otherwise(F.col("both") / F.nullif(union, F.lit(0)))
    crowd = F.coalesce(F.sum("lost") / F.sum("places"), F.lit(0.0))
    return rows.agg(F.avg(recall).alias("recall"), F.avg(jaccard).alias("jaccard"), F.avg("f").alias("offered"), crowd.alias("crowd_out"))


def sweep_curve(tools: DataFrame, questions: DataFrame, gold: DataFrame, sizes: Sequence[int], k: int = retrieval.TOOLS, floor: float = retrieval.FLOOR, search: int = 40) -> DataFrame:
    """size, real, questions, recall, jaccard, crowd_out, offered, and the tokens semantic, full, native of each of the nested catalogs.

    tools: n (place, the real ones first), id, embedding, synthetic, chars of its
    definition. questions: query, q; those without gold (query, id) don't count.
    A synthetic tool that is chosen loses its place; crowd_out is the share of
    places so lost. Tokens: of k definitions by id, of the whole catalog at the
    mean of the real ones, and of a quarter of that with the search tool's chars.
    """
    asked = questions.join(gold.select("query").distinct(), "query", "left_semi")
    table = F.array(*map(F.lit, sorted(sizes)))
    chosen = retrieval.nested_topk(tools, asked, sizes, k, floor).join(tools.select("id", "synthetic"), "id")
    found = chosen.groupBy("query", "size").agg(F.collect_set(F.when(~F.col("synthetic"), F.col("id"))).alias("f"), F.count("*").alias("places"), F.count_if("synthetic").alias("lost"))
    wanted = gold.groupBy("query").agg(F.collect_set("id").alias("g"))
    rows = asked.select("query", F.explode(table).alias("size")).join(found, ["query", "size"], "left").join(wanted, "query")
    rows = rows.withColumn("f", F.coalesce("f", F.array().cast(found.schema["f"].dataType)))
    points = rows.groupBy("size").agg(
        F.count("*").alias("questions"),
        F.avg(F.size(F.array_intersect("f", "g")) / F.size("g")).alias("recall"),
        F.avg(metrics.jaccard(F.col("f"), F.col("g"))).alias("jaccard"),
        F.coalesce(F.sum("lost") / F.sum("places"), F.lit(0.0)).alias("crowd_out"),
        F.avg(F.size("f")).alias("offered"),
    )
    listed = lambda total, n: F.floor((total + F.greatest(n - 1, F.lit(0)) + 2) / F.lit(3.5).cast("double"))  # noqa: E731  (a JSON list: brackets and commas)
    real = tools.where("not synthetic")
    each = real.agg((listed(F.sum("chars"), F.count("*")) / F.count("*")).alias("per_tool"))
    first = real.orderBy("id").limit(k).agg(listed(F.sum("chars"), F.count("*")).alias("semantic"))
    counted = tools.agg(*(F.count_if((F.col("n") < s) & ~F.col("synthetic")).alias(f"r{s}") for s in sizes), *(F.count_if(F.col("n") < s).alias(f"c{s}") for s in sizes))
    # One row each: the means, the first tools, and the counts of every size.
    whole = points.crossJoin(F.broadcast(each)).crossJoin(F.broadcast(first)).crossJoin(F.broadcast(counted))
    of = lambda name: reduce(lambda out, s: out.when(F.col("size") == s, F.col(f"{name}{s}")), sizes[1:], F.when(F.col("size") == sizes[0], F.col(f"{name}{sizes[0]}")))
    full = F.floor(F.col("per_tool") * of("c")).alias("full")
    native = F.floor(F.col("per_tool") * 0.25 * of("c") + search / 3.5).alias("native")
    return whole.select("size", of("r").alias("real"), "questions", "recall", "jaccard", "crowd_out", "offered", "semantic", full, native)


def tool_text(properties: Column) -> Column:
    """What a tool is embedded by: name, description, and its parameters by name."""
    entries = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("\n", "name", "description", F.array_join(entries, "\n"))


def consolidation_report(facts: DataFrame, clusters: DataFrame) -> DataFrame:
    """written, superseded, refused: facts of known clusters, ids that they supersede, and ids outside their cluster."""
    rows = facts.join(clusters, "cluster").select("supersedes", "members")
    inside = F.size(F.array_intersect("supersedes", "members"))
    return rows.agg(F.count("*").alias("written"), F.sum(inside).alias("superseded"), F.sum(F.size(F.array_distinct("supersedes")) - inside).alias("refused"))


def turn_scores(events: DataFrame, questions: DataFrame, always: tuple[str, ...] = ("memory_search", "memory_write")) -> DataFrame:
    """qid, class and metrics of agents' turns, from their events alone; a metric that doesn't apply is null.

    events: qid, seq, event, tool, citations (of what a call found), resolved and
    in_result_set (of a citation), names (of selected tools). questions: qid,
    class, gold_tools, gold. Tools that are always offered don't count as
    selected. Exact classes are scored by what the gold tools found, and the
    union of all that was found is only reported; the others by the passages, in
    the order in which they came.
    """
    of = lambda event: F.col("event") == event
    seen = events.join(questions.select("qid", "gold_tools"), "qid")
    asked = F.array_contains("gold_tools", F.col("tool"))
    listed = lambda when: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("seq", "citations")))), lambda x: x["citations"]))
    good = F.col("resolved") & F.col("in_result_set")
    turns = seen.groupBy("qid").agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(of("tools_selected"), F.col("names"))))).alias("selected"),
        F.array_distinct(listed(of("structured"))).alias("union"),
        F.array_distinct(listed(of("structured") & asked)).alias("asked"),
        F.array_distinct(listed(of("semantic"))).alias("passages"),
        F.avg(F.when(of("citation"), good.cast("int"))).alias("citation_resolution"),
        F.max(of("error")).alias("failed"),
    )
    # A question without any event is scored too: nothing was selected and nothing found.
    rows = questions.join(turns, "qid", "left")
    for name in ("selected", "union", "asked", "passages"):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(turns.schema[name].dataType)))
    rows = rows.withColumn("failed", F.coalesce("failed", F.lit(False)))
    scored = F.array_except("selected", F.array(*map(F.lit, always)))
    exact = F.col("class") <= EXACT
    return rows.select(
        "qid",
        "class",
        metrics.jaccard(scored, F.col("gold_tools")).alias("tool_jaccard"),
        (F.array_sort(scored) == F.array_sort(F.array_distinct("gold_tools"))).cast("double").alias("tool_exact"),
        "citation_resolution",
        F.when(exact, metrics.set_f1(F.col("asked"), F.col("gold"))).alias("set_f1"),
        F.when(exact, metrics.set_f1(F.col("union"), F.col("gold"))).alias("set_f1_union"),
        F.when(~exact, metrics.recall_at(F.col("passages"), F.col("gold"), 5)).alias("recall_at_5"),
        F.when(~exact, metrics.mrr_at(F.col("passages"), F.col("gold"), 10)).alias("mrr_at_10"),
        "failed",
    )


def config_hash(config: dict) -> str:
    """What a run's settings are known by: the first 12 digits of the SHA-256 of their JSON, keys in order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def left_to_run(questions: DataFrame, cache: DataFrame, cache_format: int) -> DataFrame:
    """The questions that the cache (qid, cache_format, error) has no result for; results of other formats, and failed ones, don't count."""
    done = cache.where((F.col("cache_format") == cache_format) & F.col("error").isNull()).select("qid").distinct()
    return questions.join(done, "qid", "left_anti")


def cached(results: DataFrame) -> DataFrame:
    """The results that may be kept: none that failed."""
    return results.where("error is null")


def baseline(current: DataFrame, results: DataFrame) -> DataFrame:
    """The metrics of a run as a new baseline; a run with errors, or of a single question, makes none and raises."""
    n, wrong = results.agg(F.count("*"), F.count_if(F.col("error").isNotNull())).first()
    if wrong or n < 2:
        raise ValueError(f"no baseline from {n} results with {wrong} errors")
    return current


def write_baseline(current: DataFrame, results: DataFrame, path: str, config: dict) -> None:
    """Writes the metrics of a run as JSON, with the hash of its settings, over an older baseline; a run that makes none raises before."""
    rows = baseline(current, results).withColumn("config", F.lit(config_hash(config)))
    rows.coalesce(1).write.mode("overwrite").json(path)


def suite_errors(sessions: DataFrame, each: int = 3) -> DataFrame:
    """scenario, error for each rule that a suite breaks.

    sessions: place (of the scenario in the suite), scenario (its id), session
    (from 0), prompt, tool, area and since that it expects, clarification. Every
    scenario has an id of its own and so many sessions, each with a prompt. The
    last one expects a tool, has a clarification for those who remember nothing,
    and doesn't name its area or time itself: it has to lean on the earlier ones.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    name = F.coalesce(F.nullif("scenario", F.lit("")), F.lit("<no id>")).alias("scenario")
    rows = sessions.select("*", F.count("*").over(Window.partitionBy("place")).alias("n"), (F.row_number().over(Window.partitionBy("place").orderBy(F.desc("session"))) == 1).alias("last"))
    last = F.col("last")
    names = lambda c: last & ~empty(c) & F.contains(F.lower("prompt"), F.lower(c))
    rules = [
        F.when(last & empty("scenario"), "no id"),
        F.when(last & (F.col("n") != each), F.concat(F.lit("sessions: "), F.col("n").cast("string"))),
        F.when(empty("prompt"), F.concat(F.lit("no prompt in session "), (F.col("session") + 1).cast("string"))),
        F.when(last & empty("tool"), "the last session expects no tool"),
        F.when(last & empty("clarification"), "the last session has no clarification"),
        F.when(names("area"), "the last session names its area"),
        F.when(names("since"), "the last session names its time"),
    ]
    broken = rows.select(name, F.explode(F.array_compact(F.array(*rules))).alias("error"))
    repeated = sessions.where(~empty("scenario")).groupBy("scenario").agg(F.countDistinct("place").alias("n")).where("n > 1").select("scenario", F.lit("repeated id"))
    return broken.union(repeated)


def prefixed(texts: Column, model: Column, prefixes: dict[str, tuple[str, str]], is_query: bool) -> Column:
    """What an embedding model is given: its prefix for queries or for passages, and the text; a model without one gets the text."""
    table = F.create_map(*(F.lit(x) for k, v in prefixes.items() for x in (k, v[0 if is_query else 1])))
    return F.concat(F.coalesce(F.try_element_at(table, model), F.lit("")), texts)


def prompt_totals(sizes: DataFrame, catalog: Column, search: int = 40) -> DataFrame:
    """full, native: tokens of a prompt with ``catalog`` tools, from the characters (chars) of the known ones.

    All definitions, or for each a quarter of one as a stub and the search tool
    of so many characters; counted at 3.5 characters a token, from below.
    """
    per_tool = F.floor(F.sum("chars") / F.lit(3.5).cast("double")) / F.count("*")
    row = sizes.agg(per_tool.alias("per_tool"))
    return row.select(F.floor(F.col("per_tool") * catalog).alias("full"), F.floor(F.col("per_tool") * 0.25 * catalog + search / 3.5).alias("native"))
