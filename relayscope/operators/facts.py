"""Exact answers about pull requests, issues, commits and releases."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entities that a rendered answer lists; its count is of all.
RENDER_LIMIT = 50


class UnknownArea(ValueError):
    def __init__(self, name: str, known: Sequence[str]) -> None:
        super().__init__(f"no area {name!r}; there are {', '.join(sorted(known))}")


class UnknownRelease(ValueError):
    def __init__(self, tags: Sequence[str]) -> None:
        super().__init__(f"no release {', '.join(sorted(tags))}")


def area_patterns(globs: Sequence[str]) -> list[str]:
    """LIKE patterns: a glob's stars at its end go, and anything may follow."""
    return [(g[:-2] if g.endswith("**") else g[:-1] if g.endswith("*") else g) + "%" for g in globs]


def area_globs(areas: dict[str, Sequence[str]], name: str) -> Sequence[str]:
    if name not in areas:
        raise UnknownArea(name, list(areas))
    return areas[name]


def in_area(path: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for pattern in area_patterns(globs):
        out = out | path.like(pattern)
    return out


def touching(rows: DataFrame, key: str, files: DataFrame, file_key: str, globs: Sequence[str] | None) -> DataFrame:
    """The rows with a file in the area: a semi join, as a row counts once however many files it has."""
    if globs is None:
        return rows
    hits = files.where(in_area(F.col("path"), globs)).select(F.col(file_key).alias("hit"))
    return rows.join(hits, rows[key] == F.col("hit"), "left_semi")


def merged_prs(prs: DataFrame, files: DataFrame, since: datetime, until: datetime, globs: Sequence[str] | None = None) -> DataFrame:
    """Pull requests merged in [since, until): all of them, the latest first."""
    rows = prs.where((F.col("state") == "merged") & (F.col("merged_at") >= F.lit(since)) & (F.col("merged_at") < F.lit(until)))
    return touching(rows, "number", files, "pr_number", globs).orderBy(F.desc("merged_at"), F.desc("number"))


def open_issues(issues: DataFrame, labels: DataFrame, label: str | None = None, milestone: str | None = None, before: datetime | None = None) -> DataFrame:
    """Open issues, by label, milestone and age (created before an instant); None doesn't filter."""
    rows = issues.where(F.col("state") == "open")
    if milestone is not None:
        rows = rows.where(F.col("milestone") == milestone)
    if before is not None:
        rows = rows.where(F.col("created_at") < F.lit(before))
    if label is not None:
        rows = rows.join(labels.where(F.col("label") == label), F.col("number") == F.col("issue_number"), "left_semi")
    return rows.orderBy("created_at", "number")


def stale_prs(prs: DataFrame, reviews: DataFrame, cutoff: datetime) -> DataFrame:
    """Open pull requests, no drafts, created before the cutoff and not reviewed after it."""
    rows = prs.where((F.col("state") == "open") & ~F.col("is_draft") & (F.col("created_at") < F.lit(cutoff)))
    recent = reviews.where(F.col("submitted_at") > F.lit(cutoff)).select("pr_number")
    return rows.join(recent, F.col("number") == F.col("pr_number"), "left_anti").orderBy("created_at", "number")


def commits_since(commits: DataFrame, since: datetime, globs: Sequence[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Commits from an instant on, in an area by any of their files (sha, path): a row a commit, the latest first."""
    rows = commits.where(F.col("committed_at") >= F.lit(since))
    return touching(rows, "sha", commits.select("sha", "path") if files is None and globs is not None else files, "sha", globs).orderBy(F.desc("committed_at"), "sha")


def commits_by_author(commits: DataFrame, since: datetime, globs: Sequence[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """author, n: the most commits first, then by name."""
    return commits_since(commits, since, globs, files).groupBy("author").agg(F.countDistinct("sha").alias("n")).orderBy(F.desc("n"), "author")


def release_diff(prs: DataFrame, releases: DataFrame, a: str, b: str) -> DataFrame:
    """Pull requests merged in [earlier, later) of two releases, in whichever order they are named."""
    found = {r["tag"]: r["published_at"] for r in releases.where(F.col("tag").isin(a, b)).select("tag", "published_at").collect()}
    if missing := {a, b} - found.keys():
        raise UnknownRelease(sorted(missing))
    low, high = sorted(found.values())
    return prs.where((F.col("state") == "merged") & (F.col("merged_at") >= F.lit(low)) & (F.col("merged_at") < F.lit(high))).orderBy("merged_at", "number")


def entities(prs: DataFrame, issues: DataFrame, commits: DataFrame, releases: DataFrame) -> DataFrame:
    """kind, key, ref, title, author, state, at, citation, url of everything that can be looked up, by key; a commit is shown by its first letters."""
    number = F.col("number").cast("string")
    first_line = F.split_part("message", F.lit("\n"), F.lit(1))

    def shaped(rows: DataFrame, kind: str, key: Column, title: Column, author: Column, state: Column, at: Column, short: Column | None = None) -> DataFrame:
        url = F.col("url") if "url" in rows.columns else F.concat(F.lit(f"/{kind}/"), key)
        ref = key if short is None else short
        citation = F.concat(F.lit(f"{kind}:"), ref)
        return rows.select(F.lit(kind).alias("kind"), key.alias("key"), ref.alias("ref"), title.alias("title"), author.alias("author"), state.alias("state"), at.alias("at"), citation.alias("citation"), url.alias("url"))

    title, author, state, nobody = F.col("title"), F.col("author"), F.col("state"), F.lit("")
    return (
        shaped(prs, "pr", number, title, author, state, F.coalesce("merged_at", "closed_at", "created_at"))
        .union(shaped(issues, "issue", number, title, author, state, F.coalesce("closed_at", "created_at")))
        .union(shaped(commits, "commit", F.col("sha"), first_line, author, F.lit("merged"), F.col("committed_at"), F.left("sha", F.lit(7))))
        .union(shaped(releases, "release", F.col("tag"), F.coalesce(F.nullif("name", F.lit("")), "tag"), nobody, F.lit("published"), F.col("published_at")))
    )


#: What the kinds of entities are called in a text.
KINDS = {"pr": "pull request", "issue": "issue", "commit": "commit", "release": "release"}


def rendered_entity() -> Column:
    """A lookup (kind, ref, and an entity's columns, of which citation is null if there is none) as text: a miss is said, and closed isn't shipped.

    Fixed values: the lines and their order.
    """
    called = reduce(lambda out, x: out.when(F.col("kind") == x[0], x[1]), list(KINDS.items())[1:], F.when(F.col("kind") == "pr", KINDS["pr"]))
    name = F.concat(called, F.lit(" "), F.col("ref"))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("**"), name, F.lit(": "), F.col("state"), F.lit("**\n")),
        F.concat(F.lit("- `"), F.col("citation"), F.lit("` — "), F.col("title")),
        F.concat(F.lit("- state: **"), F.col("state"), F.lit("**")),
        F.concat(F.lit("- date: "), F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("—"))),
        F.concat(F.lit("- author: @"), F.nullif("author", F.lit(""))),
        F.concat(F.lit("- url: "), F.col("url")),
        F.when((F.col("kind") == "pr") & (F.col("state") == "closed"), "\nThis pull request was **closed without being merged**. Its work did not ship."),
    )
    return F.when(F.col("citation").isNull(), F.concat(F.lit("**No "), name, F.lit(" exists in the corpus.**"))).otherwise(lines)


def entity(all_entities: DataFrame, kind: str, ref: str) -> DataFrame:
    """The entity of a kind by its reference, a commit by a prefix; no row if there is none."""
    if kind in ("pr", "issue") and not ref.isdigit():
        raise ValueError(f"{ref!r} is no number")
    hit = F.col("key").startswith(ref) if kind == "commit" else F.col("key") == ref
    return all_entities.where((F.col("kind") == kind) & hit)


def rendered(found: DataFrame, heading: str, order: Sequence[Column | str], area: str | None = None, globs: Sequence[str] = (), by_author: bool = False) -> DataFrame:
    """n, rendered: heading and exact count, the area's globs, if asked for the authors by what they made, and the first RENDER_LIMIT entities (citation, at, author, title) in ``order``.

    Only those reach the list; the count comes from a separate aggregate.
    """
    first = found.orderBy(*order).limit(RENDER_LIMIT).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    day = F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("—"))
    author = F.coalesce(F.concat(F.lit(" — @"), F.nullif("author", F.lit(""))), F.lit(""))
    line = F.concat(F.lit("- `"), F.col("citation"), F.lit("` "), day, author, F.lit(" — "), F.col("title"))
    listed = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    n = F.col("n")
    head = F.concat(F.lit(f"**{heading}: "), n.cast("string"), F.lit("**\n"))
    if area is not None:
        head = F.concat(head, F.lit(f"_area `{area}` resolved to: {', '.join(globs)}_\n"))
    more = F.when(n > RENDER_LIMIT, F.concat(F.lit("\n- …and "), (n - RENDER_LIMIT).cast("string"), F.lit(" more (not listed)"))).otherwise("")
    tally = F.lit("")
    people = found.groupBy("author").agg(F.count("*").alias("m")) if by_author else None
    if people is not None:
        line = F.concat(F.lit("- @"), F.col("author"), F.lit(": "), F.col("m").cast("string"))
        listed = listed.crossJoin(people.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("less"), "author", line.alias("line")))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("tally")))
        tally = F.concat(F.lit("\nBy author:\n"), F.col("tally"))
    body = F.when(n == 0, F.lit("\n(none)")).otherwise(F.concat(F.lit("\n"), F.col("lines"), more))
    return found.agg(F.count("*").alias("n")).crossJoin(listed).select("n", F.concat(head, tally, body).alias("rendered"))


def corpus_as_of(prs: DataFrame) -> DataFrame:
    """The latest instant of any pull request."""
    return prs.agg(F.max(F.greatest("merged_at", "closed_at", "created_at")).alias("as_of"))


def closed_issue_labels(issues: DataFrame, labels: DataFrame) -> DataFrame:
    """number, labels (sorted; empty if none) of the closed issues."""
    each = labels.groupBy(F.col("issue_number").alias("number")).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return issues.where("state = 'closed'").join(each, "number", "left").select("number", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The completed run that ended last."""
    return runs.where("completed_at is not null").orderBy(F.desc("completed_at"), F.desc("run_id")).limit(1)


def transcript(messages: DataFrame, roles: Sequence[str] | None = ("user", "assistant")) -> DataFrame:
    """Messages by session, turn and role (in alphabetical order: the answer before the question of its turn)."""
    rows = messages if roles is None else messages.where(F.col("role").isin(*roles))
    return rows.orderBy("session_id", "turn", "role")


def next_turn(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, next_turn: one after the largest, 0 in a session without messages."""
    last = messages.groupBy("session_id").agg(F.max("turn").alias("last"))
    return sessions.join(last, "session_id", "left").select("session_id", (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("next_turn"))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
