"""Identifiers, citations, slugs and token counts in texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What an identifier looks like among a text's words, and the parts that its case shows.
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]{2,}$"
PART = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"
#: Between words; Unicode letters count, whatever the engine's word boundary is.
BETWEEN = r"[^\p{L}\p{N}_]+"
# The kinds of citations; where two fit, the earlier one counts.
CITATIONS = {
    "comment": r"^issue:(\d+)#comment-(\d+)$",
    "body": r"^issue:(\d+)#body(?:-(\d+))?$",
    "issue": r"^issue:(\d+)$",
    "docs": r"^docs:([^#]+)#(.+)$",
    "code": r"^code:(.+):L(\d+)-L(\d+)(?:#part-(\d+))?$",
    "pr": r"^pr:(\d+)$",
    "commit": r"^commit:([0-9a-f]{7,40})$",
    "release": r"^release:(.+)$",
}
SPANS = ("docs", "code", "comment", "body")
PREFIXES = ("docs", "code", "issue", "pr", "commit", "release")
#: What ends a sentence or a bracket is no part of a citation in prose.
CLOSERS = ".,;:!?)]}'\""


def identifier_parts(identifier: Column) -> Column:
    """The words of an identifier in lower case, of two letters at least; none if there is only one."""
    words = F.filter(F.regexp_extract_all(identifier, F.lit(PART), F.lit(0)), lambda w: F.length(w) >= 2)
    return F.when(F.size(words) >= 2, F.transform(words, F.lower)).otherwise(F.array().cast("array<string>"))


def decomposed(text: Column) -> Column:
    """The words of all identifiers in a text, and the identifiers that have some, sorted."""
    words = F.filter(F.array_distinct(F.split(text, BETWEEN)), lambda w: F.rlike(w, F.lit(IDENTIFIER)))
    named = F.filter(F.transform(words, lambda i: F.struct(i.alias("name"), identifier_parts(i).alias("parts"))), lambda x: F.size(x["parts"]) > 0)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(named, lambda x: F.concat(x["parts"], F.array(F.lower(x["name"])))))))


def lexical_input(text: Column) -> Column:
    return F.concat_ws("\n", text, F.array_join(decomposed(text), " "))


def citation_kind(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(CITATIONS.items()):
        out = F.when(F.rlike(raw, F.lit(pattern)), kind).otherwise(out)
    return out


def citation(raw: Column) -> Column:
    """kind, path, number, index, tag and is_span of a citation; null if it is none."""

    def parsed(x: Column) -> Column:
        kind = x["kind"]

        def part(kinds: tuple[str, ...], i: int) -> Column:
            out = F.lit(None).cast("string")
            for k in kinds:
                out = F.when(kind == k, F.nullif(F.regexp_extract(x["raw"], CITATIONS[k], i), F.lit(""))).otherwise(out)
            return out

        index = F.coalesce(part(("comment", "body"), 2), part(("code",), 4)).try_cast("long")
        return F.struct(
            kind.alias("kind"),
            part(("docs", "code"), 1).alias("path"),
            part(("comment", "body", "issue", "pr"), 1).try_cast("long").alias("number"),
            F.when(kind.isin("body", "code"), F.coalesce(index, F.lit(0))).otherwise(index).alias("index"),
            F.coalesce(part(("docs",), 2), part(("release", "commit"), 1)).alias("tag"),
            kind.isin(*SPANS).alias("is_span"),
        )

    # Within the lambda the kind is a value; written out, it would be found again for each part.
    known = F.filter(F.array(F.struct(raw.alias("raw"), citation_kind(raw).alias("kind"))), lambda x: x["kind"].isNotNull())
    return F.get(F.transform(known, parsed), F.lit(0))


def citations_in(text: Column) -> Column:
    """The distinct citations in prose, in the order of their first place.

    One may stand between backquotes, blanks and all, or as a word that begins
    with a kind and a colon; what closes the sentence or bracket around it goes.
    """
    # Odd pieces between backquotes are quoted, the even ones are prose.
    pieces = F.transform(F.split(text, "`"), lambda p, i: F.when((i % 2 == 1) & ~F.contains(p, F.lit("\n")), F.array(p)).otherwise(F.split(p, r"[\s,;)\]]+|(?<=[(\[\"'])")))
    words = F.transform(F.flatten(pieces), lambda w: F.rtrim(F.trim(w), F.lit(CLOSERS)))
    return F.array_distinct(F.filter(words, lambda w: F.rlike(w, F.lit(f"^(?:{'|'.join(PREFIXES)}):")) & citation_kind(w).isNotNull()))


@F.pandas_udf(StringType())
def slugify(titles: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """ASCII letters and digits in lower case, joined by single dashes; accents go (Spark has no Unicode decomposition)."""
    for batch in titles:
        yield batch.map(slug, na_action="ignore")


def slug(title: str) -> str:
    plain = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


def estimated_tokens(text: Column) -> Column:
    """From above: a token for every 3.5 characters."""
    return F.ceil(F.length(text) / F.lit(3.5).cast("double")).cast("long")


def budget(most: int, header: Column, reserve: int = 16, least: int = 64) -> Column:
    return F.greatest(F.lit(least), F.lit(most - reserve) - header)


def token_windows(tokens: Column, most: int, overlap: int) -> Column:
    """The token lists of at most ``most``, each starting ``most - overlap`` after the one before, until all are covered."""

    def cut(all_tokens: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(all_tokens) - overlap - 1, F.lit(0)), F.lit(most - overlap))
        return F.transform(starts, lambda i: F.slice(all_tokens, i + 1, F.lit(most)))

    # Within the lambda the tokens are a value; written out, they would be made again for each window.
    known = F.filter(F.array(tokens), lambda t: F.size(t) > 0)
    return F.coalesce(F.get(F.transform(known, cut), F.lit(0)), F.array().cast("array<array<string>>"))


def message_text(content: Column) -> Column:
    """The text of a message that is a JSON string, or an array of blocks of which those of type text count."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), F.array_join(texts, "\n")).otherwise(content)


def blocks_of(content: Column) -> Column:
    """The blocks of a stored message: those of an array, or the whole as one text."""
    parsed = F.from_json(content, "array<struct<type:string,text:string>>")
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), parsed).otherwise(F.array(F.struct(F.lit("text").alias("type"), content.alias("text"))))


def replayable(content: Column) -> Column:
    """The blocks that may be sent again as history: texts alone; null where none is left."""
    texts = F.filter(blocks_of(content), lambda b: b["type"] == "text")
    return F.when(F.size(texts) > 0, texts)


def rendered_transcript(messages: DataFrame, by: str) -> DataFrame:
    """``by``, transcript: "[id] role: text" of the messages (id, turn, role, content) that aren't blank, an empty line between."""
    said = messages.withColumn("said", message_text(F.col("content"))).where(F.trim("said") != "")
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.col("said"))
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line"))))
    return said.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("transcript"))


def citation_of(kind: str, *parts: Column) -> Column:
    """The citation of a kind from its parts: docs (path, anchor), code (path, first, last), comment (issue, id), body (issue), or a single reference."""
    text = [p.cast("string") for p in parts]
    join = {
        "docs": lambda path, anchor: F.concat(F.lit("docs:"), path, F.lit("#"), anchor),
        "code": lambda path, first, last: F.concat(F.lit("code:"), path, F.lit(":L"), first, F.lit("-L"), last),
        "comment": lambda issue, comment: F.concat(F.lit("issue:"), issue, F.lit("#comment-"), comment),
        "body": lambda issue: F.concat(F.lit("issue:"), issue, F.lit("#body")),
        "commit": lambda sha: F.concat(F.lit("commit:"), F.left(sha, F.lit(7))),
    }
    return join[kind](*text) if kind in join else F.concat(F.lit(f"{kind}:"), *text)
