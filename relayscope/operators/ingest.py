"""Normalising landed payloads into the facts layer's tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayscope.operators.lineage import checkpointed

# What a message says when it closes an issue, and where a squashed commit names its pull request.
CLOSING = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*:?\s+#(\d+)"
SQUASHED = r"\(#(\d+)\)\s*$"


def pr_state(merged_at: Column, state: Column) -> Column:
    return F.when(merged_at.isNotNull(), "merged").when(state == "closed", "closed").otherwise("open")


def login(user: Column) -> Column:
    return F.coalesce(F.nullif(user["login"], F.lit("")), F.lit("ghost"))


def commit_author(user: Column, git_name: Column) -> Column:
    """Without an account, the name in the commit itself."""
    return F.when(user.isNull(), git_name).otherwise(login(user))


def pr_size(files: DataFrame) -> DataFrame:
    return files.groupBy("pr_number").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def closing_refs(body: Column) -> Column:
    """The distinct issue numbers that a body says it closes."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(CLOSING), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda n: n.try_cast("long")), lambda n: n.isNotNull()))


def commit_pr_number(message: Column) -> Column:
    return F.nullif(F.regexp_extract(F.split_part(message, F.lit("\n"), F.lit(1)), SQUASHED, 1), F.lit("")).try_cast("long")


def commit_pr_link(commits: DataFrame, prs: DataFrame) -> DataFrame:
    """commits with pr_number, null where that pull request isn't known."""
    known = prs.select(F.col("number").alias("known")).distinct()
    return commits.join(known, F.col("pr_number") == F.col("known"), "left").withColumn("pr_number", F.col("known")).drop("known")


def references(prs: DataFrame) -> DataFrame:
    return prs.select("number", F.explode(closing_refs(F.col("body"))).alias("issue"))


def closing_links(prs: DataFrame, issues: DataFrame, visited: str) -> DataFrame:
    """issue, pr_number: of the pull requests that close an issue, the one visited last; closed issues only."""
    last = references(prs).groupBy("issue").agg(F.max("number").alias("pr_number")) if visited == "number" else None
    if last is None:
        refs = prs.select("number", visited, F.explode(closing_refs(F.col("body"))).alias("issue"))
        last = refs.groupBy("issue").agg(F.max_by("number", visited).alias("pr_number"))
    closed = issues.where("state = 'closed'").select(F.col("number").alias("closed"))
    return last.join(closed, F.col("issue") == F.col("closed"), "left_semi")


def closing_links_dropped(prs: DataFrame, issues: DataFrame, visited: str) -> DataFrame:
    """dropped: how many referenced issues have no link, being open or unknown."""
    linked = closing_links(prs, issues, visited).select("issue", F.lit(1).alias("linked"))
    every = references(prs).select("issue").distinct().join(linked, "issue", "left")
    return every.agg((F.count("*") - F.count("linked")).alias("dropped"))


def upserted(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows that no fresh row replaces, and the fresh ones."""
    return stored.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def with_children(stored: DataFrame, fresh: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of refreshed parents are replaced as a whole, even by none."""
    return stored.join(parents.select(key).distinct(), key, "left_anti").unionByName(fresh)


def reviews_clean(reviews: DataFrame) -> DataFrame:
    """Reviews with a time, states in lower case, one for each pull request, reviewer and time."""
    rows = reviews.where("submitted_at is not null").select("pr_number", "reviewer", "submitted_at", F.lower("state").alias("state"))
    return rows.groupBy("pr_number", "reviewer", "submitted_at").agg(F.min("state").alias("state"))


def only_issues(rows: DataFrame) -> DataFrame:
    """Listed issues without those that are pull requests."""
    return rows.where(F.col("pull_request").isNull())


def listed_since(rows: DataFrame, floor: datetime) -> DataFrame:
    return rows.where(F.col("updated_at") >= F.lit(floor))


def release_rows(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.col("tag_name").alias("tag"), "name", F.coalesce("published_at", "created_at").alias("published_at"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, n of each table."""
    return reduce(DataFrame.union, (t.agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name, t in tables.items()))


def commit_rows(commits: DataFrame, prs: DataFrame) -> DataFrame:
    """sha, author, message, committed_at, pr_number of landed commits (sha, author, commit, files); a pull request that isn't known is no link."""
    made = commits.select(
        "sha",
        commit_author(F.col("author"), F.col("commit.author.name")).alias("author"),
        F.col("commit.message").alias("message"),
        F.col("commit.author.date").try_cast("timestamp_ntz").alias("committed_at"),
        commit_pr_number(F.col("commit.message")).alias("pr_number"),
    )
    return commit_pr_link(made, prs)


def commit_files(commits: DataFrame) -> DataFrame:
    """sha, path: each path of a landed commit once."""
    return commits.select("sha", F.explode("files.filename").alias("path")).where("path is not null").distinct()


def detail_rows(prs: DataFrame) -> dict[str, DataFrame]:
    """pr_files and pr_reviews of landed pull requests (number, files, reviews)."""
    files = prs.select(F.col("number").alias("pr_number"), F.inline("files")).groupBy("pr_number", F.col("filename").alias("path"))
    reviews = prs.select(F.col("number").alias("pr_number"), F.explode("reviews").alias("r"))
    return {
        "pr_files": files.agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")),
        "pr_reviews": reviews_clean(reviews.select("pr_number", login(F.col("r.user")).alias("reviewer"), F.col("r.submitted_at").try_cast("timestamp_ntz").alias("submitted_at"), F.col("r.state").alias("state"))),
    }


def milestone(payload: Column) -> Column:
    return payload["title"]


def instant(text: Column) -> Column:
    """An ISO 8601 time in UTC; null for none or for what is no time."""
    return F.nullif(text, F.lit("")).try_cast("timestamp").cast("timestamp_ntz")


def day_floor(at: Column) -> Column:
    return F.date_trunc("day", at).cast("timestamp_ntz")


def run_events(events: DataFrame) -> DataFrame:
    """run_id, started_at, completed_at, stats: runs as their appended rows (run_id, op, at, stats) tell.

    The row that completes a run is written last, so that a run without one
    isn't done; stats are the latest that any row has.
    """
    at = lambda op: F.min(F.when(F.col("op") == op, F.col("at")))
    return events.groupBy("run_id").agg(at("start").alias("started_at"), at("complete").alias("completed_at"), F.max_by("stats", F.when(F.col("stats").isNotNull(), F.col("at"))).alias("stats"))


def areas_synced(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed areas (name, globs), which replace all stored ones; raises if two have a name in common."""
    if twice := [r["name"] for r in listed.groupBy("name").count().where("count > 1").orderBy("name").limit(20).collect()]:
        raise ValueError(f"areas listed twice: {', '.join(twice)}")
    return listed.select(*stored.columns)


def unique_ids(rows: DataFrame, base: str, order: Sequence[str], scope: Sequence[str] = (), mark: str = "-") -> DataFrame:
    """``rows`` with id: in a scope and by ``order`` (no two rows alike), the base if it is free, else with the mark and the least free number from 2.

    What is free is what no earlier row has, whether as its base or by a number:
    a row may have the base "a-2". Rows are dealt to ranges of base and order,
    and a row's number is its place in its range, after those of its base in
    earlier ranges; so a base that very many rows share is no task of its own.
    Then only bases that look like another one's numbered id are looked at: each
    keeps its number from the other one's rows if it came first, and has lost
    its own name if it came later. That depends on smaller numbers and on longer
    chains of such bases, so it is repeated until nothing changes.
    """
    by = [*scope, base]
    dealt = checkpointed(rows.repartitionByRange(*by, *order).withColumn("id_range", F.spark_partition_id()), "dealt")
    earlier = Window.partitionBy(*by).orderBy("id_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*by, "id_range").agg(F.count("*").alias("id_size"))
    firsts = sizes.select(*by, "id_range", F.coalesce(F.sum("id_size").over(earlier), F.lit(0)).alias("id_before"))
    n = F.col("id_before") + F.row_number().over(Window.partitionBy(*by, "id_range").orderBy(*order))
    numbered = checkpointed(dealt.join(firsts, [*by, "id_range"]).withColumn("id_n", n), "numbered")
    moved, lost = renumbered(numbered, base, order, scope, mark)
    numbered = numbered.join(moved, by, "left").join(lost, by, "left")
    after = F.col("id_n") - 1 + F.coalesce(F.col("id_lost").cast("int"), F.lit(0))
    skipped = F.coalesce(F.size(F.filter("id_moved", lambda at: at <= after)), F.lit(0))
    named = F.when(after == 0, F.col(base)).otherwise(F.concat(base, F.lit(mark), (after + 1 + skipped).cast("string")))
    return numbered.select(*rows.columns, named.alias("id"))


def renumbered(numbered: DataFrame, base: str, order: Sequence[str], scope: Sequence[str], mark: str) -> tuple[DataFrame, DataFrame]:
    """By scope and base: id_moved, the numbered rows (from 1) from which on numbers are one higher; and id_lost, whether its own name is another row's."""
    when = F.struct(*order)
    by = [*scope, base]
    form = f"^(.+){re.escape(mark)}([2-9]|[1-9][0-9]+)$"
    names = numbered.where("id_n = 1").select(*scope, F.col(base).alias("id_name"), when.alias("id_first"))
    likely = names.select(*names.columns, F.regexp_extract("id_name", form, 1).alias(base), F.regexp_extract("id_name", form, 2).try_cast("long").alias("id_number")).where("id_number is not null")
    other = names.select(*scope, F.col("id_name").alias(base))
    state = checkpointed(likely.join(other, by, "left_semi").withColumns({"id_skips": F.lit(0).cast("long"), "id_taken": F.lit(False), "id_kept": F.lit(False)}), "numbers")
    times = numbered.select(*by, F.col("id_n").alias("id_at"), when.alias("id_time"))
    smaller = Window.partitionBy(*by).orderBy("id_number").rowsBetween(Window.unboundedPreceding, -1)
    changed = not state.isEmpty()
    while changed:
        parents = state.select(*scope, F.col("id_name").alias(base), F.col("id_taken").alias("id_parent_taken"))
        # The row of the other base that would have the number, had nothing held it.
        at = F.col("id_number") - F.col("id_skips") - F.coalesce(F.col("id_parent_taken").cast("int"), F.lit(0))
        there = state.join(parents, by, "left").withColumn("id_at", at).join(times, [*by, "id_at"], "left")
        kept, taken = F.coalesce(F.col("id_first") < F.col("id_time"), F.lit(False)), F.coalesce(F.col("id_time") < F.col("id_first"), F.lit(False))
        rows = there.select(*by, "id_name", "id_first", "id_number", F.col("id_skips").alias("id_old"), (taken != F.col("id_taken")).alias("id_turned"), taken.alias("id_taken"), kept.alias("id_kept"))
        skips = F.coalesce(F.sum(F.col("id_kept").cast("long")).over(smaller), F.lit(0))
        after = checkpointed(rows.withColumn("id_skips", skips), "numbers")
        changed = not after.where("id_turned or id_skips <> id_old").isEmpty()
        state = after.select(*state.columns)
    moved = state.where("id_kept").groupBy(*by).agg(F.collect_list(F.col("id_number") - 1 - F.col("id_skips")).alias("id_moved"))
    return moved, state.where("id_taken").select(*scope, F.col("id_name").alias(base), F.lit(True).alias("id_lost"))
