"""Queries of windows, identifiers, citations, chunks of tokens and transcripts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from relayscope.functions import text as T
from relayscope.functions import windows
from relayscope.operators import chunking, ingest
from relayscope.plans import model
from relayscope.plans.model import read

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return keep


FORMS = "list_extract(['last ' || (event_id % 40 + 1) || ' days', 'last ' || (event_id % 9 + 1) || ' months', strftime(ts, '%Y-%m'), '2023-Q' || (event_id % 4 + 1), '2024-H1', 'since 2023-' || lpad((event_id % 12 + 1)::VARCHAR, 2, '0') || '-05', 'last ' || (event_id % 3 + 1) || ' years', 'since 2023-02-3' || event_id % 2, '2023-02-30..2023-03-0' || (event_id % 9 + 1), 'last 9999999999' || event_id || ' days', 'last ' || (event_id + 4000000) || ' weeks', '2023-1' || (event_id % 7 + 3)], (event_id % 12 + 1)::INT)"


@query(
    f"""WITH e AS (SELECT event_id, ts, {FORMS} AS expression FROM events), m AS (SELECT *, event_id % 12 AS f, event_id AS i FROM e)
    SELECT event_id, expression, CASE f WHEN 0 THEN ts - to_days((i % 40 + 1)::INT) WHEN 1 THEN ts - to_months((i % 9 + 1)::INT) WHEN 2 THEN date_trunc('month', ts)::TIMESTAMP
        WHEN 3 THEN make_timestamp(2023, 3 * (i % 4) + 1, 1, 0, 0, 0) WHEN 4 THEN TIMESTAMP '2024-01-01' WHEN 5 THEN make_timestamp(2023, i % 12 + 1, 5, 0, 0, 0) WHEN 6 THEN ts - to_years((i % 3 + 1)::INT) END AS since,
        CASE f WHEN 2 THEN least(ts, (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP) WHEN 3 THEN least(ts, make_timestamp(2023, 3 * (i % 4) + 1, 1, 0, 0, 0) + INTERVAL 3 MONTH)
        WHEN 4 THEN least(ts, TIMESTAMP '2024-07-01') WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL WHEN 10 THEN NULL WHEN 11 THEN NULL ELSE ts END AS until FROM m"""
)
def window_resolve(s, d):
    """A column of expressions, each with its own as-of instant; a good part of them are no windows."""
    e, i = read(s, d, "events"), F.col("event_id")
    n = lambda k: (i % k + 1).cast("string")
    forms = F.array(
        F.concat(F.lit("last "), n(40), F.lit(" days")),
        F.concat(F.lit("last "), n(9), F.lit(" months")),
        F.date_format("ts", "yyyy-MM"),
        F.concat(F.lit("2023-Q"), n(4)),
        F.lit("2024-H1"),
        F.concat(F.lit("since 2023-"), F.lpad(n(12), 2, "0"), F.lit("-05")),
        F.concat(F.lit("last "), n(3), F.lit(" years")),
        F.concat(F.lit("since 2023-02-3"), (i % 2).cast("string")),
        F.concat(F.lit("2023-02-30..2023-03-0"), n(9)),
        F.concat(F.lit("last 9999999999"), i.cast("string"), F.lit(" days")),
        F.concat(F.lit("last "), (i + 4_000_000).cast("string"), F.lit(" weeks")),
        F.concat(F.lit("2023-1"), (i % 7 + 3).cast("string")),
    )
    rows = e.select("event_id", F.get(forms, (i % 12).cast("int")).alias("expression"), "ts").withColumn("w", windows.resolved(F.col("expression"), F.col("ts")))
    return rows.select("event_id", "expression", "w.since", "w.until")


@query("SELECT o_orderkey AS number FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1999-04-01' AND o_orderdate < TIMESTAMP '2001-08-01'")
def window_since_release(s, d):
    tags = {r["tag"]: r["published_at"] for r in model.releases(s, d).where("tag = 'v1999.2'").collect()}
    since, until = windows.resolve("since release v1999.2", datetime(2001, 8, 1), tags)
    p = model.pull_requests(s, d).where("state = 'merged'")
    return p.where((F.col("merged_at") >= F.lit(since)) & (F.col("merged_at") < F.lit(until))).select("number")


# The same parts without look-ahead: a capital that begins a word is set apart first.
PARTS = "list_transform(list_filter(regexp_extract_all(regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+'), lambda w: len(w) >= 2), lambda w: lower(w))"
NAMES = "list_extract(['get_' || event_type || '_HTTPException', 'getURLOf' || event_type, 'v' || event_id || 'Beta', 'toB' || event_id, event_type, 'parseV' || user_id || 'Router', 'HTTP'], (event_id % 7 + 1)::INT)"


def event_name():
    kind, i = F.col("event_type"), F.col("event_id").cast("string")
    forms = [F.concat(F.lit("get_"), kind, F.lit("_HTTPException")), F.concat(F.lit("getURLOf"), kind), F.concat(F.lit("v"), i, F.lit("Beta")), F.concat(F.lit("toB"), i), kind, F.concat(F.lit("parseV"), F.col("user_id").cast("string"), F.lit("Router")), F.lit("HTTP")]
    return F.get(F.array(*forms), (F.col("event_id") % 7).cast("int"))


@query(f"SELECT event_id, CASE WHEN len(p) >= 2 THEN p ELSE [] END AS parts FROM (SELECT event_id, {PARTS.format(x=NAMES)} AS p FROM events)")
def identifier_split(s, d):
    return read(s, d, "events").select("event_id", T.identifier_parts(event_name()).alias("parts"))


DECOMPOSED = f"""SELECT {{key}}, coalesce(list_sort(list_distinct(flatten(list({PARTS.format(x='w')} || [lower(w)]) FILTER (len({PARTS.format(x='w')}) >= 2)))), []) AS parts
    FROM (SELECT {{key}}, unnest(CASE WHEN len(ws) = 0 THEN [''] ELSE ws END) AS w FROM (SELECT {{key}}, list_filter(regexp_split_to_array({{text}}, '[^\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda x: regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]{{{{2,}}}}')) AS ws FROM {{table}})) GROUP BY 1"""


@query(DECOMPOSED.format(key="doc_id", text="text || ' parseV' || n_chars || '_' || lang", table="documents").replace("{{", "{").replace("}}", "}"))
def identifier_decompose(s, d):
    """Whole texts, each with an identifier of its own."""
    text = F.concat("text", F.lit(" parseV"), F.col("n_chars").cast("string"), F.lit("_"), "lang")
    return read(s, d, "documents").select("doc_id", T.decomposed(text).alias("parts"))


RAW = "list_extract(['issue:' || doc_id || '#comment-' || doc_id % 9, 'issue:' || doc_id || '#body', 'issue:' || doc_id, 'docs:' || source || '.md#' || lang, 'code:' || source || '.py:L' || doc_id || '-L' || doc_id, 'pr:' || doc_id, 'commit:' || left(sha256(doc_id::VARCHAR), 7), 'release:' || doc_id || '.0', 'pr:' || source], (doc_id % 9 + 1)::INT)"
KIND = "list_extract(['comment', 'body', 'issue', 'docs', 'code', 'pr', 'commit', 'release', NULL], (doc_id % 9 + 1)::INT)"


def raw_citation():
    i = F.col("doc_id").cast("string")
    c = F.concat
    forms = F.array(
        c(F.lit("issue:"), i, F.lit("#comment-"), (F.col("doc_id") % 9).cast("string")),
        c(F.lit("issue:"), i, F.lit("#body")),
        c(F.lit("issue:"), i),
        c(F.lit("docs:"), F.col("source"), F.lit(".md#"), F.col("lang")),
        c(F.lit("code:"), F.col("source"), F.lit(".py:L"), i, F.lit("-L"), i),
        c(F.lit("pr:"), i),
        c(F.lit("commit:"), F.left(F.sha2(i, 256), F.lit(7))),
        c(F.lit("release:"), i, F.lit(".0")),
        c(F.lit("pr:"), F.col("source")),
    )
    return F.get(forms, (F.col("doc_id") % 9).cast("int"))


@query(
    f"""SELECT doc_id, {KIND} AS kind, CASE WHEN doc_id % 9 IN (0, 1, 2, 5) THEN doc_id END AS number, CASE doc_id % 9 WHEN 0 THEN doc_id % 9 WHEN 1 THEN 0 WHEN 4 THEN 0 END AS "index",
    CASE doc_id % 9 WHEN 3 THEN source || '.md' WHEN 4 THEN source || '.py' END AS path FROM documents"""
)
def citation_parse(s, d):
    rows = read(s, d, "documents").select("doc_id", T.citation(raw_citation()).alias("c"))
    return rows.select("doc_id", "c.kind", "c.number", "c.index", "c.path")


@query("SELECT doc_id, CASE WHEN doc_id % 9 < 8 THEN doc_id % 9 IN (0, 1, 3, 4) END AS is_span FROM documents")
def citation_is_span(s, d):
    return read(s, d, "documents").select("doc_id", T.citation(raw_citation())["is_span"].alias("is_span"))


@query(f"SELECT doc_id, CASE WHEN {KIND} IS NULL THEN ['pr:7'] WHEN {RAW} = 'pr:7' THEN ['pr:7'] ELSE [{RAW}, 'pr:7'] END AS found FROM documents")
def citation_scan(s, d):
    prose = F.concat(F.lit("See `"), raw_citation(), F.lit("` and pr:7, then pr:7."))
    return read(s, d, "documents").select("doc_id", T.citations_in(prose).alias("found"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def slugify(s, d):
    return read(s, d, "documents").select("doc_id", T.slugify("text").alias("slug"))


@query(
    """SELECT doc_id, ['docs:' || source || '.md#' || lang, 'code:' || source || '.py:L' || doc_id || '-L' || n_chars, 'issue:' || doc_id || '#comment-' || n_chars, 'issue:' || doc_id || '#body', 'issue:' || doc_id, 'pr:' || doc_id,
    'commit:' || left(sha256(text), 7), 'release:' || source] AS citations FROM documents"""
)
def citation_build(s, d):
    i, n, source = F.col("doc_id"), F.col("n_chars"), F.col("source")
    every = [
        T.citation_of("docs", F.concat(source, F.lit(".md")), F.col("lang")),
        T.citation_of("code", F.concat(source, F.lit(".py")), i, n),
        T.citation_of("comment", i, n),
        T.citation_of("body", i),
        T.citation_of("issue", i),
        T.citation_of("pr", i),
        T.citation_of("commit", F.sha2("text", 256)),
        T.citation_of("release", source),
    ]
    return read(s, d, "documents").select("doc_id", F.array(*every).alias("citations"))


@query("SELECT doc_id, sha256(text) AS content_sha FROM documents")
def content_sha(s, d):
    return read(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha"))


@query(
    """WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '') AS tokens FROM documents)
    SELECT doc_id, i AS part, array_to_string(tokens[i * 80 + 1 : i * 80 + 100], ' ') AS content FROM t, unnest(range(0, greatest(1, ceil((len(tokens) - 20) / 80.0))::BIGINT)) AS r(i) WHERE len(tokens) > 0"""
)
def token_windows(s, d):
    tokens = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    parts = read(s, d, "documents").select("doc_id", F.posexplode(T.token_windows(tokens, 100, 20)).alias("part", "tokens"))
    return parts.select("doc_id", F.col("part").cast("long").alias("part"), F.array_join("tokens", " ").alias("content"))


@query(
    """SELECT doc_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM (SELECT doc_id, source || '/' || lang AS base,
    row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)"""
)
def unique_ids(s, d):
    rows = read(s, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang").alias("base"))
    return ingest.unique_ids(rows, "base", ["doc_id"]).select("doc_id", "id")


@query(
    """WITH RECURSIVE b AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, lang || CASE WHEN doc_id % 5 = 1 THEN '-' || doc_id % 7 + 2 WHEN doc_id % 11 = 3 THEN '-2-' || doc_id % 3 + 1 ELSE '' END AS base FROM documents),
    step AS (
        SELECT b.doc_id, b.source, b.i, b.base AS id, [b.base] AS used FROM b WHERE i = 1
        UNION ALL
        SELECT b.doc_id, b.source, b.i, x.id, list_append(s.used, x.id) FROM step s JOIN b ON b.source = s.source AND b.i = s.i + 1,
            LATERAL (SELECT CASE WHEN NOT list_contains(s.used, b.base) THEN b.base ELSE b.base || '-' || list_filter(range(2, b.i + 3), lambda n: NOT list_contains(s.used, b.base || '-' || n))[1] END AS id) x
    ) SELECT doc_id, id FROM step"""
)
def unique_ids_nested(s, d):
    """Bases of which some look like others' numbered ids, within each source."""
    i = F.col("doc_id")
    end = F.when(i % 5 == 1, F.concat(F.lit("-"), (i % 7 + 2).cast("string"))).when(i % 11 == 3, F.concat(F.lit("-2-"), (i % 3 + 1).cast("string"))).otherwise("")
    rows = read(s, d, "documents").select("doc_id", "source", F.concat("lang", end).alias("base"))
    return ingest.unique_ids(rows, "base", ["doc_id"], ["source"]).select("doc_id", "id")


@query(
    """WITH human AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn FROM conversations WHERE role <> 'system')
    SELECT conv_id, (rn - 1) // 5 AS run, count(*) AS comments, string_agg(text, chr(10) ORDER BY rn) AS content FROM human GROUP BY 1, 2"""
)
def comment_runs(s, d):
    rows = read(s, d, "conversations").select(F.col("conv_id").alias("issue"), "turn", F.col("role").alias("author"), F.col("text").alias("body"))
    runs = chunking.comment_runs(rows, ["turn", "author"], bots=("system",))
    return runs.select(F.col("issue").alias("conv_id"), "run", "comments", "content")


@query("SELECT doc_id, ceil(length(text) / 3.5::DOUBLE)::BIGINT AS tokens FROM documents")
def estimate_tokens(s, d):
    return read(s, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || 'more' END AS content FROM conversations")
def message_text(s, d):
    block = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    blocks = F.to_json(F.array(block("text", F.col("text")), block("image", F.lit("x")), block("text", F.lit("more"))))
    raw = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(blocks)
    return read(s, d, "conversations").select("conv_id", "turn", T.message_text(raw).alias("content"))


@query(
    """SELECT conv_id, string_agg('[m' || conv_id || '-' || turn || '] ' || role || ': ' || text, chr(10) || chr(10) ORDER BY turn, role) AS transcript FROM conversations
    WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id"""
)
def render_transcript(s, d):
    rows = read(s, d, "conversations").where(F.col("role").isin("user", "assistant"))
    name = F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return T.rendered_transcript(rows.select("conv_id", name.alias("id"), "turn", "role", F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))).alias("content")), "conv_id")


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN [text] WHEN 1 THEN [text, role] END AS texts FROM conversations WHERE turn % 3 < 2")
def replayable(s, d):
    """Messages as a plain text, as blocks with a tool's among them, and as a tool's block alone, which goes."""
    block = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    mixed = F.to_json(F.array(block("text", F.col("text")), block("tool_use", F.lit("x")), block("text", F.col("role"))))
    alone = F.to_json(F.array(block("tool_use", F.lit("x"))))
    content = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, mixed).otherwise(alone)
    rows = read(s, d, "conversations").select("conv_id", "turn", T.replayable(content).alias("blocks")).where("blocks is not null")
    return rows.select("conv_id", "turn", F.transform("blocks", lambda b: b["text"]).alias("texts"))


@query()
def doc_sections(s, d):
    """Pages' headings as Markdown, cut into sections; a stateful parse, so tests hold the cases."""
    h1 = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    body = F.regexp_replace("html", "<[^>]*>", " ")
    return chunking.doc_sections(read(s, d, "pages").select(F.col("url").alias("path"), F.concat(F.lit("# "), h1, F.lit("\n\n"), body).alias("content")))


@query()
def code_chunks(s, d):
    """Texts as modules: what isn't Python falls back to windows of lines."""
    source = F.concat(F.lit("def f():\n    return '''"), F.replace("text", F.lit("'''"), F.lit("")), F.lit("'''\n"))
    return chunking.code_chunks(read(s, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), source.alias("content")))
