"""Landed responses of a service, made of the given tables and written as lines of JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayscope.operators import ingest
from relayscope.operators.lineage import new_path
from relayscope.plans.model import read
from relayscope.sources import landed

QUERIES, ORACLES = {}, {}
#: Folders that this process wrote, by application and input.
WRITTEN: dict[tuple[str, str], str] = {}


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return keep


def landing(s, d):
    """Pages of two versions of each issue, of releases and of comments; some lines and payloads are broken, and every page of comments lands twice."""
    key = (s.sparkContext.applicationId, d)
    if key in WRITTEN:
        return WRITTEN[key]
    o, c = read(s, d, "orders"), read(s, d, "conversations")
    k = F.col("o_orderkey")
    label = F.struct(F.concat(F.lit("p"), (F.col("o_custkey") % 3).cast("string")).alias("name"))
    labels = {"old": F.array(label, label, F.struct(F.lit("x").alias("name"))), "new": F.when(F.col("o_custkey") % 3 > 0, F.array(F.struct(F.lit("y").alias("name"))))}
    issue = lambda hour, title: F.struct(labels[title].alias("labels"), F.lit("closed").alias("state"), F.when(k % 9 != 1, k).alias("number"), F.lit(title).alias("title"), F.struct(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("login")).alias("user"), F.when(k % 9 != 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(f"T{hour}:00:00Z"))).alias("updated_at"))
    pages = o.groupBy((k - k % 8).alias("page")).agg(F.collect_list(issue("08", "old")).alias("old"), F.collect_list(issue("09", "new")).alias("new"))
    line = lambda kind, ref, page: F.to_json(F.struct(F.lit(kind).alias("kind"), ref.alias("ref"), page.alias("page")))
    none = F.lit(None).cast("string")
    parts = [
        pages.select(line("issue", none, F.col("old")).alias("value")),
        pages.select(F.when(F.col("page") % 80 == 0, F.concat(F.lit("{"), line("issue", none, F.col("new")))).when(F.col("page") % 80 == 8, line("wiki", none, F.col("new"))).otherwise(line("issue", none, F.col("new"))).alias("value")),
        o.select(F.date_format("o_orderdate", "yyyy-MM").alias("m")).distinct().select(line("release", none, F.array(F.struct(F.col("m").alias("tag_name"), F.concat("m", F.lit("-01T00:00:00Z")).alias("created_at"))))),
    ]
    said = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("conv_id") * 100 + F.col("turn") * 3 + F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)).alias("id"), F.struct(F.col("role").alias("login")).alias("user"), F.col("text").alias("body")))).alias("page"))
    comments = said.select(line("comment", F.col("conv_id").cast("string"), F.col("page")).alias("value"))
    path = new_path(s, "landing")
    reduce(DataFrame.union, parts).write.text(f"{path}/listings")
    for copy in ("first", "again"):
        comments.write.text(f"{path}/comments-{copy}")
    WRITTEN[key] = path
    return path


ISSUES = """k AS (SELECT o_orderkey AS k, o_orderkey - o_orderkey % 8 AS page, o_custkey, o_orderdate FROM orders), two AS (SELECT *, unnest(['old', 'new']) AS v FROM k), there AS (SELECT * FROM two WHERE v = 'old' OR page % 80 NOT IN (0, 8))"""
COMMENTS = "(SELECT DISTINCT conv_id, turn, role, text FROM conversations)"


@query(
    f"""WITH {ISSUES} SELECT 'issue' AS kind, CASE WHEN k % 9 = 1 THEN 'no number' WHEN k % 9 = 2 THEN 'no updated_at' END AS reason, count(DISTINCT v || k % 9 || coalesce(CASE WHEN k % 9 = 1 THEN o_custkey::VARCHAR || o_orderdate ELSE k::VARCHAR END, '')) AS n FROM there GROUP BY 2
    UNION ALL SELECT NULL, 'no JSON', count(DISTINCT page) FROM k WHERE page % 80 = 0 UNION ALL SELECT 'wiki', 'unknown kind', count(DISTINCT page) FROM k WHERE page % 80 = 8
    UNION ALL SELECT 'release', NULL, count(DISTINCT strftime(o_orderdate, '%Y-%m')) FROM k UNION ALL SELECT 'comment', NULL, count(*) FROM {COMMENTS}"""
)
def landed_counts(s, d):
    return landed.counts(landed.payloads(s, landing(s, d))).select("kind", "reason", "n")


@query(f"WITH {ISSUES} SELECT k AS number, min(v) AS title, 'u' || o_custkey AS author FROM there WHERE k % 9 NOT IN (1, 2) GROUP BY k, o_custkey")
def landed_issues(s, d):
    """Of each issue the version that was updated last."""
    return landed.records(landed.payloads(s, landing(s, d)), "issue").select("number", "title", F.col("user.login").alias("author"))


@query(f"SELECT conv_id AS issue, count(*) AS n, count(DISTINCT role) AS people, sum(length(text))::BIGINT AS chars FROM {COMMENTS} GROUP BY 1")
def landed_comments(s, d):
    return landed.issue_comments(landed.payloads(s, landing(s, d))).groupBy("issue").agg(F.count("*").alias("n"), F.countDistinct("author").alias("people"), F.sum(F.length("body")).alias("chars"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS tag, date_trunc('month', o_orderdate)::TIMESTAMP AS published_at FROM orders")
def landed_releases(s, d):
    return landed.releases(landed.payloads(s, landing(s, d))).select("tag", "published_at")


@query(
    f"""WITH {ISSUES}, good AS (SELECT DISTINCT k, v, o_custkey % 3 AS p FROM there WHERE k % 9 NOT IN (1, 2)), last AS (SELECT k, min(v) AS v, any_value(p) AS p FROM good GROUP BY k)
    SELECT k AS issue_number, unnest(CASE WHEN v = 'old' THEN ['p' || p, 'x'] WHEN p > 0 THEN ['y'] ELSE [] END) AS label FROM last"""
)
def ingest_labels(s, d):
    """Two runs over what landed, the old versions and then the new ones: a refreshed issue has its new labels, even none, and no old ones."""
    rows = landed.payloads(s, landing(s, d))
    of = lambda title: landed.tables(rows.where((F.col("kind") != "issue") | F.contains("text", F.lit(f'"title":"{title}"'))))
    return landed.stored_after(of("old"), of("new"))["issue_labels"]


@query(
    f"""WITH {ISSUES}, good AS (SELECT DISTINCT k, v, o_custkey % 3 AS p FROM there WHERE k % 9 NOT IN (1, 2)), last AS (SELECT k, min(v) AS v, any_value(p) AS p FROM good GROUP BY k)
    SELECT 'issues' AS kind, count(*) AS n FROM last UNION ALL SELECT 'issue_labels', sum(CASE WHEN v = 'old' THEN 2 WHEN p > 0 THEN 1 ELSE 0 END)::BIGINT FROM last
    UNION ALL SELECT 'releases', count(DISTINCT strftime(o_orderdate, '%Y-%m')) FROM k UNION ALL SELECT unnest(['pull_requests', 'commits', 'commit_files']), 0"""
)
def ingest_run(s, d):
    """All tables of what landed, counted by kind; of pull requests and commits nothing landed here."""
    return ingest.counts(landed.tables(landed.payloads(s, landing(s, d))))
