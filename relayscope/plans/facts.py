"""Queries of the facts layer and of ingest normalisation, each with its oracle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayscope.operators import facts, ingest
from relayscope.plans import model
from relayscope.plans.model import AREAS, sql

# The instants that the queries ask about.
AS_OF = datetime(2001, 8, 1)
SINCE, UNTIL = datetime(1997, 1, 1), datetime(1997, 4, 1)
EVENTS_SINCE = datetime(2024, 1, 10)
S, U = "TIMESTAMP '1997-01-01'", "TIMESTAMP '1997-04-01'"
COLD = "(path LIKE 'cold/%' OR path LIKE 'blue/%')"

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None, *tables: str, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = sql(oracle, *tables) if tables else oracle
        return f

    return keep


def prs(s: SparkSession, d: str) -> DataFrame:
    return model.pull_requests(s, d)


@query(f"SELECT number, merged_at FROM pull_requests WHERE state = 'merged' AND merged_at >= {S} AND merged_at < {U}", "pull_requests")
def merged_prs(s, d):
    return facts.merged_prs(prs(s, d), model.pr_files(s, d), SINCE, UNTIL).select("number", "merged_at")


@query(
    f"""SELECT number, merged_at FROM pull_requests WHERE state = 'merged' AND merged_at >= {S} AND merged_at < {U}
    AND EXISTS (SELECT 1 FROM pr_files WHERE pr_number = number AND {COLD})""",
    "pull_requests",
    "pr_files",
)
def merged_prs_area(s, d):
    return facts.merged_prs(prs(s, d), model.pr_files(s, d), SINCE, UNTIL, facts.area_globs(AREAS, "cold")).select("number", "merged_at")


@query("SELECT number FROM issues WHERE state = 'open' AND EXISTS (SELECT 1 FROM issue_labels WHERE issue_number = number AND label = 'building')", "issues", "issue_labels")
def open_issues_label(s, d):
    return facts.open_issues(model.issues(s, d), model.issue_labels(s, d), label="building").select("number")


@query("SELECT number FROM issues WHERE state = 'open' AND milestone = '1-URGENT'", "issues")
def open_issues_milestone(s, d):
    return facts.open_issues(model.issues(s, d), model.issue_labels(s, d), milestone="1-URGENT").select("number")


@query("SELECT number, created_at FROM issues WHERE state = 'open' AND created_at < TIMESTAMP '2001-08-01' - INTERVAL 1000 DAY", "issues")
def open_issues_age(s, d):
    before = s.range(1).select((F.lit(AS_OF) - F.make_dt_interval(F.lit(1000))).alias("t")).first()["t"]
    return facts.open_issues(model.issues(s, d), model.issue_labels(s, d), before=before).select("number", "created_at")


def stale(days: int):
    from datetime import timedelta

    @query(
        f"""SELECT number FROM pull_requests WHERE state = 'open' AND NOT is_draft AND created_at < TIMESTAMP '2001-08-01' - INTERVAL {days} DAY
        AND NOT EXISTS (SELECT 1 FROM pr_reviews WHERE pr_number = number AND submitted_at > TIMESTAMP '2001-08-01' - INTERVAL {days} DAY)""",
        "pull_requests",
        "pr_reviews",
        name=f"stale_prs_{days}",
    )
    def run(s, d):
        return facts.stale_prs(prs(s, d), model.pr_reviews(s, d), AS_OF - timedelta(days=days)).select("number")


for _days in (14, 90, 365, 730):
    stale(_days)


@query("SELECT sha FROM commits WHERE committed_at >= TIMESTAMP '2024-01-10'", "commits")
def commits_since(s, d):
    return facts.commits_since(model.commits(s, d), EVENTS_SINCE).select("sha")


@query("SELECT author, count(DISTINCT sha) AS n FROM commits WHERE committed_at >= TIMESTAMP '2024-01-10' GROUP BY author", "commits")
def commits_by_author(s, d):
    return facts.commits_by_author(model.commits(s, d), EVENTS_SINCE)


@query("SELECT author, count(DISTINCT sha) AS n FROM commits WHERE committed_at >= TIMESTAMP '2024-01-10' AND EXISTS (SELECT 1 FROM commit_paths f WHERE f.sha = commits.sha AND f.path LIKE 'click/%') GROUP BY author", "commits", "commit_paths")
def commits_by_author_area(s, d):
    return facts.commits_by_author(model.commits(s, d), EVENTS_SINCE, facts.area_globs(AREAS, "clicks"), model.commit_paths(s, d))


ENTITIES = """SELECT 'pr' AS kind, number::VARCHAR AS key, number::VARCHAR AS ref, title, author, state, coalesce(merged_at, closed_at, created_at) AS "at", 'pr:' || number AS citation, '/pr/' || number AS url FROM pull_requests
    UNION ALL SELECT 'issue', number::VARCHAR, number::VARCHAR, title, author, state, coalesce(closed_at, created_at), 'issue:' || number, '/issue/' || number FROM issues
    UNION ALL SELECT 'commit', sha, left(sha, 7), split_part(message, chr(10), 1), author, 'merged', committed_at, 'commit:' || left(sha, 7), '/commit/' || sha FROM commits
    UNION ALL SELECT 'release', tag, tag, coalesce(name, tag), '', 'published', published_at, 'release:' || tag, '/release/' || tag FROM releases"""
ALL = ("pull_requests", "issues", "commits", "releases")


def entities(s, d):
    return facts.entities(prs(s, d), model.issues(s, d), model.commits(s, d), model.releases(s, d))


@query(ENTITIES, *ALL)
def entity_projection(s, d):
    return entities(s, d)


def lookup(name: str, kind: str, ref: str, where: str):
    @query(f"SELECT * FROM ({ENTITIES}) WHERE kind = '{kind}' AND {where}", *ALL, name=name)
    def run(s, d):
        return facts.entity(entities(s, d), kind, ref)


lookup("entity_pr", "pr", "7", "key = '7'")
lookup("entity_issue", "issue", "33", "key = '33'")
lookup("entity_commit_prefix", "commit", "5f", "key LIKE '5f%'")
lookup("entity_release", "release", "v1997.2", "key = 'v1997.2'")


@query(
    """SELECT number, merged_at FROM pull_requests, (SELECT min(published_at) AS low, max(published_at) AS high FROM releases WHERE tag IN ('v1997.3', 'v1997.1'))
    WHERE state = 'merged' AND merged_at >= low AND merged_at < high""",
    "pull_requests",
    "releases",
)
def release_diff(s, d):
    return facts.release_diff(prs(s, d), model.releases(s, d), "v1997.3", "v1997.1").select("number", "merged_at")


@query(
    f"""WITH found AS (SELECT title, author, number, merged_at, 'pr:' || number AS citation FROM pull_requests WHERE state = 'merged' AND merged_at >= {S} AND merged_at < {U} AND EXISTS (SELECT 1 FROM pr_files WHERE pr_number = number AND {COLD})),
    first AS (SELECT * FROM found ORDER BY merged_at DESC, number DESC LIMIT 50), n AS (SELECT count(*) AS n FROM found)
    SELECT n, '**Merged pull requests: ' || n || '**' || chr(10) || '_area `cold` resolved to: cold/**, blue/**_' || chr(10) || chr(10)
        || (SELECT string_agg('- `' || citation || '` ' || strftime(merged_at, '%Y-%m-%d') || ' — @' || author || ' — ' || title, chr(10) ORDER BY merged_at DESC, number DESC) FROM first)
        || CASE WHEN n > 50 THEN chr(10) || '- …and ' || (n - 50) || ' more (not listed)' ELSE '' END AS rendered FROM n""",
    "pull_requests",
    "pr_files",
)
def render_aggregate(s, d):
    globs = facts.area_globs(AREAS, "cold")
    found = facts.merged_prs(prs(s, d), model.pr_files(s, d), SINCE, UNTIL, globs)
    rows = found.select("title", "author", "number", F.col("merged_at").alias("at"), F.concat(F.lit("pr:"), F.col("number").cast("string")).alias("citation"))
    return facts.rendered(rows, "Merged pull requests", [F.desc("at"), F.desc("number")], "cold", globs)


@query(
    """WITH f AS (SELECT sha, author, committed_at, split_part(message, chr(10), 1) AS title FROM commits WHERE committed_at >= TIMESTAMP '2024-01-10'), t AS (SELECT author, count(*) AS m FROM f GROUP BY 1)
    SELECT (SELECT count(*) FROM f) AS n, '**Commits since 2024-01-10: ' || (SELECT count(*) FROM f) || '**' || chr(10) || chr(10) || 'By author:' || chr(10) || (SELECT string_agg('- @' || author || ': ' || m || chr(10), '' ORDER BY m DESC, author) FROM t)
    || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY committed_at DESC, sha) FROM (SELECT *, '- `commit:' || left(sha, 7) || '` ' || strftime(committed_at, '%Y-%m-%d') || ' — @' || author || ' — ' || title AS line FROM f ORDER BY committed_at DESC, sha LIMIT 50))
    || chr(10) || '- …and ' || (SELECT count(*) FROM f) - 50 || ' more (not listed)' AS rendered""",
    "commits",
)
def render_commits(s, d):
    """The tally by author stands before the list."""
    rows = facts.commits_since(model.commits(s, d), EVENTS_SINCE)
    found = rows.select(F.concat(F.lit("commit:"), F.left("sha", F.lit(7))).alias("citation"), F.col("committed_at").alias("at"), "author", F.split_part("message", F.lit("\n"), F.lit(1)).alias("title"), "sha")
    return facts.rendered(found, "Commits since 2024-01-10", [F.desc("at"), "sha"], by_author=True)


@query("SELECT max(greatest(merged_at, closed_at, created_at)) AS as_of FROM pull_requests", "pull_requests")
def corpus_as_of(s, d):
    return facts.corpus_as_of(prs(s, d))


@query(
    """SELECT area, count(DISTINCT path) AS files FROM (SELECT path, CASE WHEN path LIKE 'click/%' THEN 'clicks' END AS area FROM commits
    UNION ALL SELECT path, CASE WHEN path LIKE 'view/1.py%' THEN 'exact' END FROM commits UNION ALL SELECT path, CASE WHEN path LIKE 'view/%' THEN 'views' END FROM commits
    UNION ALL SELECT path, CASE WHEN path LIKE 'cold/%' OR path LIKE 'blue/%' THEN 'cold' END FROM commits UNION ALL SELECT path, CASE WHEN path LIKE '_old/%' THEN 'any' END FROM commits
    UNION ALL SELECT path, CASE WHEN path LIKE 'cold/%' OR path LIKE 'blue/%' THEN 'cold' END FROM pr_files UNION ALL SELECT path, CASE WHEN path LIKE '_old/%' THEN 'any' END FROM pr_files)
    WHERE area IS NOT NULL GROUP BY area""",
    "commits",
    "pr_files",
)
def files_by_area(s, d):
    """Areas are a few patterns, so a path gets the array of those that it is in, without a join."""
    paths = model.commits(s, d).select("path").union(model.pr_files(s, d).select("path")).distinct()
    areas = F.array(*(F.when(facts.in_area(F.col("path"), globs), name) for name, globs in AREAS.items()))
    each = paths.select("path", F.explode(F.array_compact(areas)).alias("area"))
    return each.groupBy("area").agg(F.count("*").alias("files"))


@query(
    """SELECT number, coalesce(labels, []) AS labels FROM issues LEFT JOIN (SELECT issue_number, list_sort(list(DISTINCT label)) AS labels FROM issue_labels GROUP BY 1)
    ON number = issue_number WHERE state = 'closed'""",
    "issues",
    "issue_labels",
)
def closed_issue_labels(s, d):
    return facts.closed_issue_labels(model.issues(s, d), model.issue_labels(s, d))


RUNS = "SELECT o_orderkey AS run_id, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at FROM orders"


@query(f"SELECT * FROM ({RUNS}) WHERE completed_at IS NOT NULL ORDER BY completed_at DESC, run_id DESC LIMIT 1")
def latest_run(s, d):
    return facts.latest_run(prs(s, d).select(F.col("number").alias("run_id"), F.col("created_at").alias("started_at"), F.col("merged_at").alias("completed_at")))


def messages(s, d):
    return model.read(s, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


@query("SELECT conv_id AS session_id, turn, role, text AS content FROM conversations WHERE role IN ('user', 'assistant')")
def transcript(s, d):
    return facts.transcript(messages(s, d))


@query("SELECT conv_id AS session_id, max(turn) + 1 AS next_turn FROM conversations GROUP BY conv_id")
def next_turn(s, d):
    return facts.next_turn(messages(s, d).select("session_id").distinct(), messages(s, d))


# --- ingest -----------------------------------------------------------------


def payload(s, d):
    """Orders as the payloads that a source of pull requests would land."""
    p = prs(s, d)
    return p.select(
        "number",
        F.when(F.col("state") == "open", "open").otherwise("closed").alias("state"),
        "merged_at",
        "created_at",
        F.when(F.col("number") % 7 != 0, F.struct(F.when(F.col("number") % 5 != 0, F.col("author")).alias("login"))).alias("user"),
        F.concat(F.lit("Closes #"), (F.col("number") + 1).cast("string"), F.lit(" and fixes: #"), (F.col("number") * 2).cast("string"), F.lit(", see #9")).alias("body"),
    )


@query(
    """SELECT number, CASE WHEN merged_at IS NOT NULL THEN 'merged' WHEN state = 'open' THEN 'open' ELSE 'closed' END AS state,
    CASE WHEN number % 7 = 0 OR number % 5 = 0 THEN 'ghost' ELSE author END AS author FROM pull_requests""",
    "pull_requests",
)
def pr_state(s, d):
    p = payload(s, d)
    return p.select("number", ingest.pr_state(F.col("merged_at"), F.col("state")).alias("state"), ingest.login(F.col("user")).alias("author"))


@query("SELECT pr_number, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM pr_files GROUP BY pr_number", "pr_files")
def pr_size(s, d):
    return ingest.pr_size(model.pr_files(s, d))


@query("SELECT o_orderkey AS number, list_sort(list_distinct([o_orderkey + 1, o_orderkey * 2])) AS issues FROM orders")
def closing_refs(s, d):
    return payload(s, d).select("number", F.array_sort(ingest.closing_refs(F.col("body"))).alias("issues"))


@query("SELECT sha, nullif(regexp_extract(split_part(message, chr(10), 1), '\\(#(\\d+)\\)\\s*$', 1), '')::BIGINT AS pr_number FROM commits", "commits")
def commit_pr_number(s, d):
    return model.commits(s, d).select("sha", ingest.commit_pr_number(F.col("message")).alias("pr_number"))


@query(
    """SELECT sha, number AS pr_number FROM (SELECT sha, nullif(regexp_extract(split_part(message, chr(10), 1), '\\(#(\\d+)\\)\\s*$', 1), '')::BIGINT AS n FROM commits)
    LEFT JOIN pull_requests ON n = number AND state = 'merged'""",
    "commits",
    "pull_requests",
)
def commit_pr_link(s, d):
    c = model.commits(s, d).select("sha", ingest.commit_pr_number(F.col("message")).alias("pr_number"))
    return ingest.commit_pr_link(c, prs(s, d).where("state = 'merged'"))


LINKS = """WITH refs AS (SELECT DISTINCT number, unnest([number + 1, number * 2]) AS issue FROM pull_requests), last AS (SELECT issue, max(number) AS pr_number FROM refs GROUP BY issue)
    SELECT issue, pr_number FROM last WHERE issue IN (SELECT number FROM issues WHERE state = 'closed')"""


@query(LINKS, "pull_requests", "issues")
def closing_links(s, d):
    return ingest.closing_links(payload(s, d), model.issues(s, d), "number")


@query(
    f"""WITH refs AS (SELECT DISTINCT unnest([number + 1, number * 2]) AS issue FROM pull_requests), linked AS ({LINKS.replace('WITH refs', 'WITH refs2').replace('FROM refs GROUP', 'FROM refs2 GROUP')})
    SELECT (SELECT count(*) FROM refs) - (SELECT count(*) FROM linked) AS dropped""",
    "pull_requests",
    "issues",
)
def closing_links_dropped(s, d):
    return ingest.closing_links_dropped(payload(s, d), model.issues(s, d), "number")


@query("SELECT number, CASE WHEN number % 10 = 1 THEN 'new ' || title ELSE title END AS title FROM pull_requests WHERE number % 10 <> 0 OR number % 20 = 0", "pull_requests")
def upsert_prs(s, d):
    p = prs(s, d).select("number", "title")
    fresh = p.where("number % 10 = 1").withColumn("title", F.concat(F.lit("new "), F.col("title"))).union(p.where("number % 20 = 0"))
    return ingest.upserted(p.where("number % 10 <> 0"), fresh, ["number"])


@query("SELECT issue_number, count(*) AS labels FROM issue_labels GROUP BY 1", "issue_labels")
def issue_labels(s, d):
    return model.issue_labels(s, d).groupBy("issue_number").agg(F.count("*").alias("labels"))


@query(
    """SELECT DISTINCT pr_number, reviewer, submitted_at, lower(state) AS state FROM pr_reviews WHERE submitted_at IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY pr_number, reviewer, submitted_at ORDER BY lower(state)) = 1""",
    "pr_reviews",
)
def reviews_clean(s, d):
    return ingest.reviews_clean(model.pr_reviews(s, d))


@query(
    """SELECT 'pull_requests' AS kind, count(*) AS n FROM pull_requests UNION ALL SELECT 'issues', count(*) FROM issues UNION ALL SELECT 'commits', count(*) FROM commits
    UNION ALL SELECT 'releases', count(*) FROM releases""",
    *ALL,
)
def ingest_counts(s, d):
    return ingest.counts({"pull_requests": prs(s, d), "issues": model.issues(s, d), "commits": model.commits(s, d), "releases": model.releases(s, d)})


@query("SELECT number, created_at FROM pull_requests WHERE created_at >= TIMESTAMP '1999-01-01'", "pull_requests")
def ingest_pr_window(s, d):
    return ingest.listed_since(prs(s, d).withColumn("updated_at", F.col("created_at")), datetime(1999, 1, 1)).select("number", "created_at")


@query(
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN lang <> 'en' THEN 'translated' WHEN source = 'src0' THEN 'skipped' WHEN source IN ('src1', 'src2') THEN 'docs'
    WHEN source = 'src3' THEN 'code' ELSE 'unsupported' END AS reason FROM documents) GROUP BY reason"""
)
def walk_classify(s, d):
    from relayscope.sources.tree import classified

    docs = model.read(s, d, "documents")
    src, i = F.col("source"), F.col("doc_id").cast("string")
    name = F.when(src.isin("src1", "src2"), F.concat(i, F.lit(".md"))).when(src == "src3", F.concat(i, F.lit(".py"))).otherwise(F.concat(i, F.lit(".png")))
    folder = F.when(F.col("lang") != "en", F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"))).when(src == "src0", F.lit(".github/")).otherwise(F.lit("docs/en/"))
    return docs.select(classified(F.concat(folder, name)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
