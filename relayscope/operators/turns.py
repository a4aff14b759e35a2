"""What the turns of an agent returned, cited and cost, from its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayscope.functions.text import SPANS

# Dollars for a million tokens.
PRICES = {"input_tokens": 5.0, "output_tokens": 25.0, "cache_read": 0.5, "cache_write": 6.25}
MEMORY_TOOLS = ("memory_search", "memory_write")


def turn_results(calls: DataFrame) -> DataFrame:
    """turn, citation, is_span of what the tools returned; memory tools return nothing that can be cited."""
    rows = calls.where(~F.col("tool").isin(*MEMORY_TOOLS) & ~F.col("is_error"))
    return rows.select("turn", F.explode("citations").alias("c")).select("turn", F.col("c.raw").alias("citation"), F.col("c.kind").isin(*SPANS).alias("is_span")).distinct()


def citation_checks(cited: DataFrame, known: DataFrame, results: DataFrame) -> DataFrame:
    """turn, citation, resolved, in_result_set, once for each citation of a turn."""
    once = cited.select("turn", "citation").distinct()
    real = known.select("citation", F.lit(True).alias("real")).distinct()
    seen = results.select("turn", "citation", F.lit(True).alias("seen")).distinct()
    rows = once.join(real, "citation", "left").join(seen, ["turn", "citation"], "left")
    return rows.select("turn", "citation", F.coalesce("real", F.lit(False)).alias("resolved"), F.coalesce("seen", F.lit(False)).alias("in_result_set"))


def cost(prices: dict[str, float] = PRICES) -> Column:
    return F.round(sum((F.coalesce(F.col(k), F.lit(0)) * v for k, v in prices.items()), F.lit(0.0)) / 1_000_000, 6)


def gold_tool_entities(calls: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, entities of the calls of gold tools, each once, in the order of their first place."""
    rows = calls.join(gold.select("qid", "tool").distinct(), ["qid", "tool"], "left_semi").select("qid", "seq", F.posexplode("entities").alias("place", "entity"))
    first = rows.groupBy("qid", "entity").agg(F.min(F.struct("seq", "place")).alias("at"))
    return first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entity"))), lambda x: x["entity"]).alias("entities"))


def turn_record(events: DataFrame) -> DataFrame:
    """turn, session_id, tools, areas, windows, memories, writes, cost, latency_ms, error of each turn's events.

    events: turn, seq, event, status, tool, kind, area, window, n, cost,
    latency_ms, session_id. Tools are those of calls that went well, areas and
    windows those of complete sets that have some, all in order and as often as
    they came; what is told once is taken from the last event that tells it.
    """
    at = lambda event: F.col("event") == event
    structured = at("retrieval") & (F.col("kind") == "structured")
    listed = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when & F.col(value).isNotNull(), F.struct("seq", value)))), lambda x: x[value])
    last = lambda event, value: F.max_by(value, F.when(at(event), F.col("seq")))
    return events.groupBy("turn").agg(
        last("session", "session_id").alias("session_id"),
        listed(at("tool_call") & (F.col("status") == "ok"), "tool").alias("tools"),
        listed(structured, "area").alias("areas"),
        listed(structured, "window").alias("windows"),
        F.coalesce(last("memory_loaded", "n"), F.lit(0)).cast("long").alias("memories"),
        F.count_if(at("memory_write")).alias("writes"),
        F.round(F.coalesce(last("done", "cost"), F.lit(0.0)), 6).alias("cost"),
        F.coalesce(last("done", "latency_ms"), F.lit(0)).cast("long").alias("latency_ms"),
        F.coalesce(F.bool_or(at("error")), F.lit(False)).alias("error"),
    )


def scenario_turns(records: DataFrame, expected: DataFrame, most: int = 3) -> DataFrame:
    """scenario, turns until the expected tool was called in the expected area; null if it wasn't within ``most``."""
    rows = expected.join(records, "scenario", "left")
    hit = F.array_contains("tools", F.col("want_tool")) & (F.col("want_area").isNull() | F.array_contains("areas", F.col("want_area"))) & (F.col("turn") <= most)
    return rows.groupBy("scenario").agg(F.min(F.when(hit, F.col("turn"))).alias("turns"))
