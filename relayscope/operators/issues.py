"""Chunks of issues: bodies and threads of comments, packed by tokens in column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a chunk with its header, what parts share, the least budget, comments of a run, and tokens kept free for an author's name.
MOST, OVERLAP, LEAST, RUN, NAME = 496, 96, 64, 5, 8
# Accounts that aren't people.
BOTS = ("github-actions[bot]", "dependabot[bot]", "pre-commit-ci[bot]", "codecov[bot]", "codecov-commenter", "sonarcloud[bot]")
WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
Count = Callable[[Column], Column]


def tokens(text: Column) -> Column:
    """Words and marks; what is counted by default."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def counted(text: Column) -> Column:
    return F.size(tokens(text))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def units(text: Column, most: Column, overlap: int, count: Count = counted) -> Column:
    """The paragraphs of a text, those that are too long by lines, and lines that are too long by windows of tokens; the text itself if it is blank."""

    def windows(line: Column) -> Column:
        def cut(words: Column) -> Column:
            starts = F.sequence(F.lit(0), F.size(words) - 1, F.greatest(F.lit(1), most - overlap))
            return F.transform(starts, lambda at: F.array_join(F.slice(words, at + 1, most), " "))

        return F.when(count(line) <= most, F.array(line)).otherwise(bound(tokens(line), cut))

    def by_lines(part: Column) -> Column:
        lines = F.filter(F.split(part, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), lambda x: F.rlike(x, F.lit(r"\S")))
        split = bound(lines, lambda x: F.when(F.size(x) > 1, x).otherwise(F.array(part)))
        return F.when(count(part) <= most, F.array(part)).otherwise(F.flatten(F.transform(split, windows)))

    parts = F.filter(F.split(text, r"\n\s*\n"), lambda x: F.rlike(x, F.lit(r"\S")))
    return bound(parts, lambda x: F.when(F.size(x) == 0, F.array(text)).otherwise(F.flatten(F.transform(x, by_lines))))


def packed(sizes: Column, most: Column, overlap: int) -> Column:
    """Parts (arrays of places from 0) of units with these sizes, filled greedily; a joiner costs one.

    A part begins with the last units of the one before that are within the
    overlap, unless the unit that comes doesn't fit behind them. A unit that is
    too long is a part with what it finds there. One fold over the sizes.
    """
    nothing = F.array().cast("array<int>")
    start = F.struct(F.array().cast("array<array<int>>").alias("parts"), nothing.alias("held"), F.lit(0).alias("total"))
    of = lambda x: F.get(sizes, x)

    def step(state: Column, i: Column) -> Column:
        def tail(state: Column) -> Column:
            """What of the part goes on: places, and their size; size -1 once one was too long."""
            first = F.struct(nothing.alias("held"), F.lit(0).alias("total"), F.lit(False).alias("full"))

            def add(t: Column, x: Column) -> Column:
                fits = ~t["full"] & (t["total"] + of(x) <= overlap)
                return F.struct(F.when(fits, F.concat(F.array(x), t["held"])).otherwise(t["held"]).alias("held"), (t["total"] + F.when(fits, of(x)).otherwise(0)).alias("total"), (~fits).alias("full"))

            return F.aggregate(F.reverse(state["held"]), first, add)

        def after(state: Column) -> Column:
            over = (F.size(state["held"]) > 0) & (state["total"] + of(i) + 1 > most)
            fresh = F.struct(nothing.alias("held"), F.lit(0).alias("total"))
            kept = bound(tail(state), lambda t: F.when(t["total"] + of(i) + 1 > most, fresh).otherwise(F.struct(t["held"].alias("held"), t["total"].alias("total"))))
            going = F.when(over, kept).otherwise(F.struct(state["held"].alias("held"), state["total"].alias("total")))
            done = F.when(over, F.concat(state["parts"], F.array(state["held"]))).otherwise(state["parts"])
            return bound(going, lambda g: F.struct(done.alias("parts"), F.concat(g["held"], F.array(i)).alias("held"), (g["total"] + of(i) + 1).alias("total")))

        return bound(state, after)

    places = F.when(F.size(sizes) > 0, F.sequence(F.lit(0), F.size(sizes) - 1)).otherwise(nothing)
    return F.aggregate(places, start, step, lambda s: F.concat(s["parts"], F.array(s["held"])))


def split_text(text: Column, most: Column, overlap: int, count: Count = counted) -> Column:
    """The parts of a text, each as text."""

    def parts(found: Column) -> Column:
        made = bound(F.transform(found, count), lambda sizes: packed(sizes, most, overlap))
        return F.transform(made, lambda part: F.array_join(F.transform(part, lambda i: F.get(found, i)), "\n\n"))

    return bound(units(text, most, overlap, count), parts)


def budget(header: Column, most: int, least: int, count: Count) -> Column:
    return F.greatest(F.lit(least), F.lit(most) - count(header))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


COLUMNS = ("id", "issue", "anchor", "content", "tokens")


def body_chunks(issues: DataFrame, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST, count: Count = counted) -> DataFrame:
    """COLUMNS of the bodies of ``issues`` (issue, title, body, labels): each part behind the title and the sorted labels, an empty body as these alone."""
    header = F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.when(F.size("labels") > 0, F.concat(F.lit("labels: "), F.array_join(F.array_sort("labels"), ", "))))
    rows = issues.withColumn("header", header).withColumn("room", budget(F.concat("header", F.lit("\n")), most, least, count)).withColumn("text", stripped(F.col("body")))
    parts = rows.select("issue", "title", "header", F.posexplode(split_text(F.col("text"), F.col("room"), overlap, count)).alias("n", "part"))
    parts = parts.withColumn("content", stripped(F.concat("header", F.lit("\n"), "part"))).where("content <> ''")
    number = F.when(F.col("n") == 0, "").otherwise(F.concat(F.lit("-"), F.col("n").cast("string")))
    anchor = F.when(F.col("n") == 0, F.col("title")).otherwise(F.concat("title", F.lit(" (body "), (F.col("n") + 1).cast("string"), F.lit(")")))
    return parts.select(F.concat(F.lit("issue:"), F.col("issue").cast("string"), F.lit("#body"), number).alias("id"), "issue", anchor.alias("anchor"), "content", count(F.col("content")).alias("tokens"))


def thread_chunks(
    issues: DataFrame, comments: DataFrame, order: Sequence[str], most: int = MOST, overlap: int = OVERLAP, least: int = LEAST, count: Count = counted, bots: Sequence[str] = BOTS, run: int = RUN
) -> DataFrame:
    """COLUMNS of the threads of ``issues``: people's ``comments`` (issue, author, body) in order, ``run`` at a time, packed by tokens.

    A comment that is too long is split, and each piece begins with its author.
    A part says which comments it is of. Bots and blank comments don't count;
    without a name the author is "unknown". Of an unknown issue nothing is made.
    """
    author = F.coalesce("author", F.lit(""))
    people = comments.where(~author.isin(*bots) & F.rlike(F.coalesce("body", F.lit("")), F.lit(r"\S")))
    n = F.row_number().over(Window.partitionBy("issue").orderBy(*order))
    head = issues.select("issue", "title", F.concat(F.lit("# "), "title", F.lit("\n\n")).alias("header")).withColumn("room", budget(F.col("header"), most, least, count))
    rows = people.select("issue", n.alias("n"), F.when(author == "", "unknown").otherwise(author).alias("author"), stripped(F.col("body")).alias("text")).join(head, "issue")
    pieces = rows.select("issue", "title", "header", "room", "n", F.floor((F.col("n") - 1) / run).alias("run"), "author", F.posexplode(split_text(F.col("text"), F.col("room") - NAME, overlap, count)).alias("k", "piece"))
    said = F.concat(F.lit("@"), F.col("author"), F.lit(": "), F.col("piece"))
    runs = pieces.groupBy("issue", "run", "title", "header", "room").agg(F.array_sort(F.collect_list(F.struct("n", "k", said.alias("said")))).alias("units"))
    made = F.transform("units", lambda u: count(u["said"]))
    parts = runs.select("*", F.posexplode(bound(made, lambda sizes: packed(sizes, F.col("room"), overlap))).alias("p", "part"))
    at = lambda i: F.get("units", i)["n"]
    content = F.concat("header", F.array_join(F.transform("part", lambda i: F.get("units", i)["said"]), "\n\n"))
    first, last = at(F.get("part", F.lit(0))), at(F.get("part", F.size("part") - 1))
    anchor = F.concat("title", F.lit(" (comments "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")"))
    index = F.row_number().over(Window.partitionBy("issue").orderBy("run", "p")) - 1
    out = parts.select("issue", "run", "p", anchor.alias("anchor"), content.alias("content")).withColumn("index", index)
    return out.select(F.concat(F.lit("issue:"), F.col("issue").cast("string"), F.lit("#comment-"), F.col("index").cast("string")).alias("id"), "issue", "anchor", "content", count(F.col("content")).alias("tokens"))
