"""Queries of question sets, sweeps and consolidation, each with its oracle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from relayscope.operators import evals, metrics, retrieval
from relayscope.plans.model import read
from relayscope.plans.retrieval import COS

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return keep


@query("SELECT DISTINCT source || '/' || lang || '%' AS pattern FROM documents")
def area_prefixes(s, d):
    """Each source as a glob with stars; the stars go and anything follows."""
    globs = read(s, d, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("**")).alias("g")).distinct()
    return globs.select(F.concat(F.regexp_replace("g", r"\*{1,2}$", ""), F.lit("%")).alias("pattern"))


@query(
    """WITH q AS (SELECT doc_id, CASE WHEN doc_id % 50 = 49 THEN doc_id - 1 ELSE doc_id END::VARCHAR AS qid, doc_id % 8 AS class, doc_id % 9 AS k, doc_id % 11 AS a, doc_id % 13 AS m FROM documents),
    t AS (SELECT *, class BETWEEN 1 AND 6 AND a <> 3 AS timed, CASE a WHEN 1 THEN '2024-01-02' WHEN 2 THEN '2022-12-31' ELSE '2023-06-01' END AS as_of, class <= 4 AS exact FROM q)
    SELECT qid, 'class must be 1-6, not ' || class AS error FROM t WHERE class NOT BETWEEN 1 AND 6 UNION ALL SELECT qid, 'empty question' FROM t WHERE class BETWEEN 1 AND 6 AND k = 0 UNION ALL SELECT qid, 'no gold tools' FROM t WHERE class BETWEEN 1 AND 6 AND k IN (1, 2)
    UNION ALL SELECT qid, 'no as_of' FROM t WHERE class BETWEEN 1 AND 6 AND a = 3 UNION ALL SELECT qid, 'as_of 2024-01-02 is after the pin' FROM t WHERE timed AND a = 1
    UNION ALL SELECT qid, 'no query' FROM t WHERE timed AND exact AND m = 0 UNION ALL SELECT qid, 'unknown method launch' FROM t WHERE timed AND exact AND m = 1 UNION ALL SELECT qid, 'merged_prs takes no since_when, who' FROM t WHERE timed AND exact AND m = 2
    UNION ALL SELECT qid, 'as_of 2022-12-31 is before the floor' FROM t WHERE timed AND exact AND m > 1 AND a = 2 UNION ALL SELECT qid, 'since 2022-01-01 is before the floor' FROM t WHERE timed AND exact AND m = 3 UNION ALL SELECT qid, 'until 2022-02-01 is before the floor' FROM t WHERE timed AND exact AND m = 3
    UNION ALL SELECT qid, 'no gold' FROM t WHERE timed AND NOT exact AND k = 3 UNION ALL SELECT qid, 'no points' FROM t WHERE timed AND NOT exact AND k IN (4, 5) UNION ALL SELECT qid, 'no chunk ' || doc_id FROM t WHERE timed AND NOT exact AND k <> 3 AND doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT qid, 'repeated id' FROM q GROUP BY qid HAVING count(*) > 1"""
)
def gold_validate(s, d):
    """Each document as a question; every rule is broken by some."""
    i = F.col("doc_id")
    k, a, m = i % 9, i % 11, i % 13
    at = lambda day: F.lit(datetime.fromisoformat(day))
    args = (
        F.when(m == 2, F.create_map(F.lit("who"), F.lit("x"), F.lit("since_when"), F.lit("y"), F.lit("since"), F.lit("2023-05-01")))
        .when(m == 3, F.create_map(F.lit("since"), F.lit("2022-01-01"), F.lit("until"), F.lit("2022-02-01")))
        .otherwise(F.create_map(F.lit("since"), F.lit("2023-05-01")))
    )
    questions = read(s, d, "documents").select(
        i.alias("place"), F.when(i % 50 == 49, i - 1).otherwise(i).cast("string").alias("qid"), (i % 8).alias("class"), F.when(k == 0, " ").otherwise("what?").alias("question"), F.when(k == 1, F.array().cast("array<string>")).when(k != 2, F.array(F.lit("t"))).alias("gold_tools"),
        F.when(a == 1, at("2024-01-02")).when(a == 2, at("2022-12-31")).when(a != 3, at("2023-06-01")).alias("as_of"), F.when(m == 1, "launch").when(m > 1, "merged_prs").alias("method"), args.alias("args"),
        F.when(k == 3, F.array().cast("array<long>")).otherwise(F.array(i)).alias("gold"), F.when(k == 4, F.array().cast("array<string>")).when(k != 5, F.array(F.lit("p"))).alias("points"),
    )
    known = read(s, d, "embeddings").select(F.col("vec_id").alias("id"))
    return evals.gold_errors(questions, known, at("2024-01-01"), at("2023-01-01"), {"merged_prs": ("since", "until", "area"), "open_issues": ("label",)})


@query(
    f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), t AS (SELECT * FROM embeddings WHERE vec_id % 100 <> 0), chosen AS (SELECT * FROM (SELECT q.vec_id AS query, t.vec_id AS id, t.vec_id % 4 = 3 AS synthetic,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format(a='t.embedding', b='q.embedding')} DESC, t.vec_id) AS rank FROM t, q WHERE {COS.format(a='t.embedding', b='q.embedding')} >= 0.25) WHERE rank <= 5),
    found AS (SELECT query, coalesce(list(id) FILTER (NOT synthetic), []) AS f FROM chosen GROUP BY 1), gold AS (SELECT q.vec_id AS query, list(t.vec_id) AS g FROM q JOIN t ON t.label = q.label AND t.vec_id % 4 <> 3 GROUP BY 1),
    pairs AS (SELECT coalesce(f, []) AS f, coalesce(g, []) AS g FROM q LEFT JOIN found ON vec_id = found.query LEFT JOIN gold ON vec_id = gold.query)
    SELECT round(avg(CASE WHEN len(g) = 0 THEN 1 ELSE len(list_intersect(f, g)) / len(g)::DOUBLE END), 6) AS recall,
    round(avg(CASE WHEN len(f) + len(g) = 0 THEN 1 ELSE len(list_intersect(f, g)) / len(list_distinct(list_concat(f, g)))::DOUBLE END), 6) AS jaccard, round(avg(len(f)), 6) AS offered,
    round(coalesce((SELECT count(*) FILTER (synthetic) / count(*)::DOUBLE FROM chosen), 0), 6) AS crowd_out FROM pairs"""
)
def sweep_point(s, d):
    """Questions are the rows whose id is divisible by 100, against all the others; every fourth tool is synthetic."""
    e = read(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("label").alias("topic"))
    tools = e.where("vec_id % 100 <> 0").select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 4 == 3).alias("synthetic"), "label")
    gold = tools.where("not synthetic").select(F.col("label").alias("topic"), "id")
    point = evals.sweep_point(tools, q, gold)
    return point.select(*(F.round(c, 6).alias(c) for c in point.columns))


SIZES = (13, 50, 200, 500)


@query(
    f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 10 = 9), t AS (SELECT *, vec_id >= 13 AS synthetic, 40 + vec_id % 7 AS chars FROM embeddings WHERE vec_id % 10 <> 9), g AS (SELECT q.vec_id AS query, list(t.vec_id) AS g FROM q JOIN t ON NOT synthetic AND t.label = q.label GROUP BY 1),
    asked AS (SELECT query, g, embedding FROM g JOIN q ON vec_id = query), z AS (SELECT unnest({list(SIZES)}) AS size),
    chosen AS (SELECT * FROM (SELECT query, size, t.vec_id AS id, synthetic, row_number() OVER (PARTITION BY query, size ORDER BY {COS.format(a='t.embedding', b='a.embedding')} DESC, t.vec_id) AS rank FROM t, asked a, z WHERE t.vec_id < size AND {COS.format(a='t.embedding', b='a.embedding')} >= 0.1) WHERE rank <= 5),
    rows AS (SELECT a.query, z.size, g, coalesce(list(id) FILTER (NOT synthetic), []) AS f, count(id) AS places, count(*) FILTER (synthetic) AS lost FROM asked a CROSS JOIN z LEFT JOIN chosen c ON c.query = a.query AND c.size = z.size GROUP BY 1, 2, 3),
    p AS (SELECT floor((sum(chars) + count(*) + 1) / 3.5::DOUBLE) / count(*) AS per_tool FROM t WHERE NOT synthetic), f AS (SELECT floor((sum(chars) + count(*) + 1) / 3.5::DOUBLE)::BIGINT AS semantic FROM (SELECT * FROM t WHERE NOT synthetic ORDER BY vec_id LIMIT 5))
    SELECT size, (SELECT count(*) FROM t WHERE NOT synthetic) AS real, count(*) AS questions, round(avg(len(list_intersect(f, g)) / len(g)::DOUBLE), 6) AS recall, round(avg(len(list_intersect(f, g)) / len(list_distinct(list_concat(f, g)))::DOUBLE), 6) AS jaccard,
        round(coalesce(sum(lost) / sum(places)::DOUBLE, 0), 6) AS crowd_out, round(avg(len(f)), 6) AS offered, (SELECT semantic FROM f) AS semantic,
        (SELECT floor(per_tool * (SELECT count(*) FROM t WHERE vec_id < size)) FROM p)::BIGINT AS full, (SELECT floor(per_tool * 0.25 * (SELECT count(*) FROM t WHERE vec_id < size) + 40 / 3.5::DOUBLE) FROM p)::BIGINT AS native FROM rows GROUP BY size"""
)
def sweep_curve(s, d):
    """Every tenth row is a question; of the others the first thirteen ids are real tools, and a catalog of a size has the ids below it."""
    e = read(s, d, "embeddings")
    i = F.col("vec_id")
    q = e.where("vec_id % 10 = 9").select(i.alias("query"), F.col("embedding").alias("q"), "label")
    tools = e.where("vec_id % 10 <> 9").select(i.alias("n"), i.alias("id"), "embedding", (i >= 13).alias("synthetic"), (40 + i % 7).alias("chars"), "label")
    gold = tools.where("not synthetic").select("id", "label").join(q.select("query", "label"), "label").select("query", "id")
    out = evals.sweep_curve(tools, q.select("query", "q"), gold, SIZES, floor=0.1)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if c != "size" else F.col(c) for c, t in out.dtypes))


@query("SELECT mode, 'tool' || vec_id AS name, mode = 'native' AND vec_id NOT IN (3, 5) AS deferred FROM embeddings, (VALUES ('full'), ('native')) m(mode)")
def tool_modes(s, d):
    """Every tool in the two kinds of selection that send all; two are always offered."""
    rows = read(s, d, "embeddings").select(F.concat(F.lit("tool"), F.col("vec_id").cast("string")).alias("name"))
    both = [retrieval.selected(rows, mode, always=("tool3", "tool5")).select(F.lit(mode).alias("mode"), "name", "deferred") for mode in ("full", "native")]
    return both[0].union(both[1])


@query("SELECT vec_id, 'tool' || vec_id || chr(10) || 'about ' || label || chr(10) || 'a: ' || label || chr(10) || 'b: ' || vec_id AS text FROM embeddings")
def tool_text(s, d):
    i, label = F.col("vec_id").cast("string"), F.col("label").cast("string")
    rows = read(s, d, "embeddings").select("vec_id", F.concat(F.lit("tool"), i).alias("name"), F.concat(F.lit("about "), label).alias("description"), F.create_map(F.lit("b"), i, F.lit("a"), label).alias("p"))
    return rows.select("vec_id", evals.tool_text(F.col("p")).alias("text"))


@query(
    """WITH members AS (SELECT l_orderkey AS cluster, list(DISTINCT l_partkey % 20) AS members FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1), facts AS (SELECT l_orderkey AS cluster, l_suppkey % 20 AS old FROM lineitem)
    SELECT count(*) AS written, count(*) FILTER (list_contains(members, old)) AS superseded, count(*) FILTER (NOT list_contains(members, old)) AS refused FROM facts JOIN members USING (cluster)"""
)
def consolidation_report(s, d):
    lines = read(s, d, "lineitem")
    clusters = lines.where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("cluster")).agg(F.collect_set(F.col("l_partkey") % 20).alias("members"))
    return evals.consolidation_report(lines.select(F.col("l_orderkey").alias("cluster"), F.array(F.col("l_suppkey") % 20).alias("supersedes")), clusters)


@query(
    """WITH f AS (SELECT user_id AS turn, list(DISTINCT event_id % 15) AS found FROM events WHERE event_type <> 'error' GROUP BY 1), g AS (SELECT user_id AS turn, list(DISTINCT event_id % 15) AS gold FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT turn, round(len(list_intersect(found, gold)) * 2.0::DOUBLE / (len(found) + len(gold)), 9) AS f1 FROM f JOIN g USING (turn)"""
)
def set_f1_union(s, d):
    """Over everything that a turn's tools returned, not only those asked for."""
    e = read(s, d, "events").select(F.col("user_id").alias("turn"), "event_type", (F.col("event_id") % 15).alias("item"))
    found = e.where("event_type <> 'error'").groupBy("turn").agg(F.collect_set("item").alias("found"))
    gold = e.where("event_type = 'view'").groupBy("turn").agg(F.collect_set("item").alias("gold"))
    return found.join(gold, "turn").select("turn", F.round(metrics.set_f1(F.col("found"), F.col("gold")), 9).alias("f1"))


