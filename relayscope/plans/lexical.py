"""Queries of the lexical arm and of both arms together, over a stored index; the oracles rank covers by windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from relayscope.functions import stems
from relayscope.operators import lexical, retrieval
from relayscope.plans import model
from relayscope.plans.model import chunks
from relayscope.plans.retrieval import DENSE, probe, rounded

QUERIES, ORACLES = {}, {}
QUESTION = "Things, and the ones of thinging"
IDENTIFIERS = "load_text of things"
#: Paths of the indexes that this process wrote, by application, input and kind.
WRITTEN: dict[tuple[str, str, str], str] = {}


def stored_index(s, d, kind="text"):
    """The index of the chunks of ``d``, written by the first query that needs it."""
    key = (s.sparkContext.applicationId, d, kind)
    if key not in WRITTEN:
        rows = chunks(s, d)
        if kind == "code":
            rows = rows.withColumn("content", F.concat("content", F.lit("\n"), line_of_code()))
        WRITTEN[key] = lexical.write_index(rows)
    return lexical.read_index(s, WRITTEN[key])


def line_of_code():
    """What stands behind every text; its identifier has the text's language in it."""
    return F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("load_text("), "source", F.lit(")"))).otherwise(F.concat(F.lit("loadText"), F.initcap("source"), F.lit("(x)")))


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def pairs(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in table.items()) + "}"


def longest(endings) -> str:
    """The longest of the endings that w has."""
    return f"list_filter({listed(sorted(endings, key=len, reverse=True))}, lambda s: ends_with(w, s))[1]"


V, N = "[aeiouy]", "[^aeiouy]"
SHORT = f"regexp_matches({{x}}, '{N}{V}[^aeiouywxY]$|^{V}{N}$')"
#: said (id, source, content) -> lexemes (id, source, term, pos); each step of the public rules is a table.
LEXEMES = f"""
    tokens AS (SELECT id, source, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT id, source, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS t FROM said)),
    known AS (SELECT DISTINCT word FROM tokens WHERE NOT list_contains({listed(stems.STOP_WORDS)}, word)),
    marked AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({V})y', '\\1Y', 'g') AS w FROM known),
    first_region AS (SELECT *, coalesce(nullif(length(regexp_extract(w, '^(gener|commun|arsen|.*?{V}{N})')), 0), length(w)) AS r1 FROM marked),
    regions AS (SELECT *, r1 + coalesce(nullif(length(regexp_extract(w[r1 + 1:], '^.*?{V}{N}')), 0), length(w) - r1) AS r2 FROM first_region),
    plain AS (SELECT * REPLACE (CASE WHEN w LIKE '%sses' THEN w[:-3] WHEN w LIKE '%ied' OR w LIKE '%ies' THEN w[:CASE WHEN length(w) > 4 THEN -3 ELSE -2 END]
        WHEN w LIKE '%us' OR w LIKE '%ss' THEN w WHEN regexp_matches(w, '{V}.+s$') THEN w[:-2] ELSE w END AS w) FROM regions),
    past AS (SELECT *, {longest(('eed', 'eedly'))} AS eed, regexp_replace(w, '(ingly|edly|ing|ed)$', '') AS b FROM plain),
    present AS (SELECT word, r1, r2, CASE WHEN list_contains({listed(stems.DONE)}, w) THEN w WHEN eed IS NOT NULL THEN CASE WHEN length(w) - length(eed) >= r1 THEN w[:length(w) - length(eed)] || 'ee' ELSE w END
        WHEN b = w OR NOT regexp_matches(b, '{V}') THEN w WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN b[:-2]
        WHEN {SHORT.format(x='b')} AND length(b) <= r1 THEN b || 'e' ELSE b END AS w FROM past),
    last_y AS (SELECT * REPLACE (CASE WHEN regexp_matches(w, '.{N}[yY]$') THEN w[:-2] || 'i' ELSE w END AS w) FROM present),
    second AS (SELECT * REPLACE (CASE WHEN e IS NULL OR length(w) - length(e) < r1 OR (e = 'ogi' AND w NOT LIKE '%logi') OR (e = 'li' AND NOT regexp_matches(w, '[cdeghkmnrt]li$')) THEN w
        ELSE w[:length(w) - length(e)] || {pairs(stems.SECOND)}[e] END AS w) FROM (SELECT *, {longest(stems.SECOND)} AS e FROM last_y)),
    third AS (SELECT * REPLACE (CASE WHEN e IS NULL OR length(w) - length(e) < CASE e WHEN 'ative' THEN r2 ELSE r1 END THEN w ELSE w[:length(w) - length(e)] || {pairs(stems.THIRD)}[e] END AS w)
        FROM (SELECT * EXCLUDE (e), {longest(stems.THIRD)} AS e FROM second)),
    fourth AS (SELECT * REPLACE (CASE WHEN e IS NULL OR length(w) - length(e) < r2 OR (e = 'ion' AND NOT regexp_matches(w, '[st]ion$')) THEN w ELSE w[:length(w) - length(e)] END AS w)
        FROM (SELECT * EXCLUDE (e), {longest(stems.FOURTH)} AS e FROM third)),
    fifth AS (SELECT word, CASE WHEN w LIKE '%e' AND (length(w) > r2 OR (length(w) > r1 AND NOT {SHORT.format(x='w[:-2]')})) THEN w[:-2] WHEN w LIKE '%ll' AND length(w) > r2 THEN w[:-2] ELSE w END AS w FROM fourth),
    stems AS (SELECT word, coalesce({pairs(stems.IRREGULAR)}[word], CASE WHEN length(word) <= 2 OR regexp_matches(word, '\\p{{N}}') OR list_contains({listed(stems.DONE)}, word) THEN word ELSE replace(w, 'Y', 'y') END) AS term FROM fifth),
    lexemes AS (SELECT id, source, term, pos FROM tokens JOIN stems USING (word))"""


def ranked(terms, source: str = "true") -> str:
    """LEXEMES, then sparse (id, score): covers are what the earliest of the terms' last places begins, up to where it first does."""
    lasts = ", ".join(f"max(CASE WHEN term = '{t}' THEN i END) OVER w" for t in terms)
    return f"""{LEXEMES},
    entries AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM lexemes WHERE list_contains({listed(terms)}, term) AND {source}),
    begun AS (SELECT id, pos, i, list_min(l) AS b FROM (SELECT *, [{lasts}] AS l FROM entries WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)) WHERE len(list_filter(l, lambda x: x IS NULL)) = 0),
    covers AS (SELECT id, b, min(i) AS e FROM begun GROUP BY id, b),
    sparse AS (SELECT c.id, sum(0.1::DOUBLE / (1 + z.pos - a.pos - (c.e - c.b))) AS score FROM covers c JOIN entries a ON a.id = c.id AND a.i = c.b JOIN entries z ON z.id = c.id AND z.i = c.e GROUP BY c.id)"""


SAID = "said AS (SELECT id, source, content FROM chunks)"
TERMS = ("one", "thing")
SPARSE = "SELECT id, score FROM sparse ORDER BY round(score, 9) DESC, id LIMIT 50"
CODE = """said AS (SELECT id, source, content || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'load_text(' || source || ')' || chr(10) || 'load load_text text'
    ELSE 'loadText' || upper(source[1]) || source[2:] || '(x)' || chr(10) || array_to_string(list_sort([source, 'load', 'text', 'loadtext' || source]), ' ') END AS content FROM chunks)"""


def query(oracle: str, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = model.sql(oracle, "chunks")
        return f

    return keep


def terms(s):
    return lexical.query_terms(s, QUESTION)


@query(f"WITH {SAID}, {ranked(TERMS)} SELECT id, round(score, 6) AS score FROM sparse")
def sparse_match(s, d):
    return rounded(lexical.sparse_match(stored_index(s, d), terms(s)), "score")


@query(f"WITH {SAID}, {ranked(TERMS)} SELECT id, round(score, 6) AS score FROM ({SPARSE})")
def sparse_topk(s, d):
    return rounded(lexical.sparse_topk(stored_index(s, d), terms(s), retrieval.ARM), "score")


@query(f"WITH {SAID}, {ranked(TERMS, "source = 'en'")} SELECT id, round(score, 6) AS score FROM ({SPARSE})")
def sparse_topk_source(s, d):
    return rounded(lexical.sparse_topk(stored_index(s, d), terms(s), retrieval.ARM, "en"), "score")


@query(f"WITH {CODE}, {ranked(("load", "text", "thing"))} SELECT id, round(score, 6) AS score FROM sparse")
def sparse_identifiers(s, d):
    return rounded(lexical.sparse_match(stored_index(s, d, "code"), lexical.query_terms(s, IDENTIFIERS)), "score")


@query(f"WITH {SAID}, {LEXEMES} SELECT term, count(DISTINCT id) AS chunks, count(*) AS places, sum(pos)::BIGINT AS place_sum FROM lexemes GROUP BY term")
def lexical_index(s, d):
    rows = stored_index(s, d).select("term", F.size("positions").alias("n"), F.aggregate("positions", F.lit(0).cast("long"), lambda t, at: t + at).alias("sum"))
    return rows.groupBy("term").agg(F.count("*").alias("chunks"), F.sum("n").alias("places"), F.sum("sum").alias("place_sum"))


FUSED = f"""{SAID}, {ranked(TERMS)}, ranks AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({DENSE.format(where='')})
    UNION ALL SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) FROM ({SPARSE})), fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ranks GROUP BY id)"""


@query(f"WITH {FUSED} SELECT id, round(score, 9) AS score FROM fused")
def rrf_fuse(s, d):
    both = retrieval.fused(retrieval.dense_topk(chunks(s, d), probe(s, d)), lexical.sparse_topk(stored_index(s, d), terms(s), retrieval.ARM))
    return both.withColumn("score", F.round("score", 9))


@query(f"WITH {FUSED} SELECT id, round(score, 9) AS score FROM (SELECT * FROM fused ORDER BY score DESC, id LIMIT 10)")
def hybrid_search(s, d):
    return retrieval.hybrid_search(chunks(s, d), probe(s, d), stored_index(s, d), terms(s)).withColumn("score", F.round("score", 9))


@query(f"WITH {SAID}, {ranked(TERMS)} SELECT count(*) AS shared FROM ({DENSE.format(where='')}) JOIN ({SPARSE}) USING (id)")
def arm_overlap(s, d):
    sparse = lexical.sparse_topk(stored_index(s, d), terms(s), retrieval.ARM).select("id")
    return retrieval.dense_topk(chunks(s, d), probe(s, d)).select("id").join(sparse, "id").agg(F.count("*").alias("shared"))
