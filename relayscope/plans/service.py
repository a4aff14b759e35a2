"""Queries of tool dispatch, landed payloads, runs, turn scores and suites, each with its oracle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from relayscope.operators import evals, ingest, memory, sessions, sync, tools
from relayscope.plans import model
from relayscope.plans.model import AREAS, read, sql
from relayscope.plans.retrieval import MEM, NOW, delta_sides, memories, probe

QUERIES, ORACLES = {}, {}
AS_OF = datetime(2001, 8, 1)


def query(oracle: str | None = None, *tables: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle, *tables) if tables else oracle
        return f

    return keep


NAMES = sorted(tools.CATALOG)
NEEDS = "[" + ", ".join("'" + ",".join(tools.CATALOG[n][2]) + "'" for n in NAMES) + "]"
LISTED = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


@query(f"SELECT event_id, {LISTED}[event_id % 13 + 1] AS name, {NEEDS}[event_id % 13 + 1] AS needs FROM events WHERE event_type <> 'signup' OR {LISTED}[event_id % 13 + 1] NOT IN ('memory_search', 'memory_write')")
def tool_catalog(s, d):
    """Each event as a call: the definition of its tool, which signups, without memory, may not have."""
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 13).cast("int"))
    calls = read(s, d, "events").select("event_id", "event_type", name.alias("name"))
    with_memory = calls.where("event_type <> 'signup'").join(tools.definitions(s), "name")
    without = calls.where("event_type = 'signup'").join(tools.definitions(s, with_memory=False), "name")
    return with_memory.union(without).select("event_id", "name", F.array_join("required", ",").alias("needs"))


FORMS = ('{"threshold_days":#}', '{"threshold_days":" # "}', '{"threshold_days":true}', '{"threshold_days":"soon"}', '{"threshold_days":null}', '{"other":#}', '{"threshold_days":2.5}', '{"area":7}', '{"area":true}', '{"area":1,"area":"#"}', "threshold_days=#", "[#]")


@query(
    """SELECT event_id, CASE event_id % 12 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN 'true' WHEN 3 THEN 'soon' WHEN 6 THEN '2.5' END AS days, CASE event_id % 12 WHEN 7 THEN '7' WHEN 8 THEN 'True' WHEN 9 THEN event_id::VARCHAR END AS area,
    CASE event_id % 12 WHEN 2 THEN 'threshold_days must be a whole number, not True' WHEN 3 THEN 'threshold_days must be a whole number, not ''soon''' WHEN 6 THEN 'threshold_days must be a whole number, not 2.5'
    WHEN 10 THEN 'the arguments are no JSON object' WHEN 11 THEN 'the arguments are no JSON object' END AS error FROM events"""
)
def tool_coerce(s, d):
    """Arguments right and wrong: a key that comes twice, and text that is no JSON object, too."""
    form = F.replace(F.get(F.array(*map(F.lit, FORMS)), (F.col("event_id") % len(FORMS)).cast("int")), F.lit("#"), F.col("event_id").cast("string"))
    declared = F.create_map(F.lit("threshold_days"), F.lit("integer"), F.lit("area"), F.lit("string"))
    rows = read(s, d, "events").select("event_id", tools.coerced(form, declared).alias("c"))
    return rows.select("event_id", F.try_element_at("c.values", F.lit("threshold_days")).alias("days"), F.try_element_at("c.values", F.lit("area")).alias("area"), "c.error")


def tables(s, d) -> tools.Tables:
    chunks = model.chunks(s, d).withColumn("source", F.lit("docs"))
    return tools.Tables(
        model.pull_requests(s, d), model.pr_files(s, d), model.pr_reviews(s, d), model.issues(s, d), model.issue_labels(s, d), model.commits(s, d), model.releases(s, d), chunks, AREAS, lambda text: probe(s, d), lambda text: text.lower().split()
    )


MERGED = "state = 'merged' AND merged_at >= TIMESTAMP '1997-01-01' AND merged_at < TIMESTAMP '1997-04-01'"
CALLS = [
    ("merged_prs", {"window": "1997-Q1"}),
    ("open_issues", {"milestone": "1-URGENT", "older_than_days": "30"}),
    ("stale_prs", {"threshold_days": 365}),
    ("pr_state", {"number": "7"}),
    ("release_diff", {"from_tag": "v1997.1", "to_tag": "v1997.3"}),
    ("merged_prs", {"window": "since release v2001.2", "area": "cold"}),
    ("merged_prs", {"window": "whenever it was"}),
    ("merged_prs", {"window": "1997", "area": "no such"}),
    ("stale_prs", {"threshold_days": True}),
    ("issue_state", {}),
    ("launch", {}),
    ("memory_search", {"query": "x"}),
]
FAILED = "('merged_prs', true, 1), ('merged_prs', true, 1), ('stale_prs', true, 1), ('issue_state', true, 1), ('launch', true, 1), ('memory_search', true, 1)"


@query(
    f"""SELECT 'merged_prs' AS tool, false AS is_error, 'pr:' || number AS citation FROM pull_requests WHERE {MERGED}
    UNION ALL SELECT 'open_issues', false, 'issue:' || number FROM issues WHERE state = 'open' AND milestone = '1-URGENT' AND created_at < TIMESTAMP '2001-07-02'
    UNION ALL SELECT 'stale_prs', false, 'pr:' || number FROM pull_requests p WHERE state = 'open' AND NOT is_draft AND created_at < TIMESTAMP '2000-08-01' AND NOT EXISTS (SELECT 1 FROM pr_reviews r WHERE r.pr_number = p.number AND r.submitted_at > TIMESTAMP '2000-08-01')
    UNION ALL SELECT 'pr_state', false, 'pr:' || number FROM pull_requests WHERE number = 7
    UNION ALL SELECT 'release_diff', false, 'pr:' || number FROM pull_requests WHERE state = 'merged' AND merged_at >= TIMESTAMP '1997-01-01' AND merged_at < TIMESTAMP '1997-07-01'
    UNION ALL SELECT 'merged_prs', false, 'pr:' || number FROM pull_requests WHERE state = 'merged' AND merged_at >= TIMESTAMP '2001-04-01' AND merged_at < TIMESTAMP '2001-08-01' AND EXISTS (SELECT 1 FROM pr_files WHERE pr_number = number AND (path LIKE 'cold/%' OR path LIKE 'blue/%'))
    UNION ALL SELECT * FROM (VALUES ('merged_prs', true, NULL), ('merged_prs', true, NULL), ('stale_prs', true, NULL), ('issue_state', true, NULL), ('launch', true, NULL), ('memory_search', true, NULL))""",
    "pull_requests",
    "pr_files",
    "pr_reviews",
    "issues",
    "releases",
)
def tool_dispatch(s, d):
    """Calls of an agent, right and wrong ones; errors are rows."""
    t, out = tables(s, d), None
    for name, arguments in CALLS:
        rows = tools.dispatched(s, name, arguments, t, AS_OF).select("tool", "is_error", "citation")
        out = rows if out is None else out.union(rows)
    return out


@query(f"SELECT 'q1' AS qid, 'pr:' || number AS citation FROM pull_requests WHERE {MERGED} UNION ALL SELECT 'q2', 'issue:' || number FROM issues WHERE state = 'open' AND milestone = '2-HIGH'", "pull_requests", "issues")
def gold_generate(s, d):
    questions = [{"id": "q1", "as_of": AS_OF, "method": "merged_prs", "args": {"window": "1997-Q1"}}, {"id": "q2", "as_of": AS_OF, "method": "open_issues", "args": {"milestone": "2-HIGH"}}]
    return tools.gold(s, questions, tables(s, d))


@query(
    f"""WITH found AS (SELECT doc_id // 5 AS call, '{tools.DOCUMENTS}' || chr(10) || chr(10) || string_agg('<document citation="' || id || '" source="' || source || '" path="p' || doc_id || '">' || chr(10) || content || chr(10) || '</document>', chr(10) ORDER BY doc_id) AS text
    FROM chunks WHERE doc_id % 15 < 10 GROUP BY 1) SELECT call, coalesce(text, '**No matching passages.**') AS text FROM (SELECT DISTINCT doc_id // 5 AS call FROM chunks) LEFT JOIN found USING (call)""",
    "chunks",
)
def render_chunks(s, d):
    """Five neighbouring chunks are what a call found; every third call found nothing."""
    rows = model.chunks(s, d).select(F.floor(F.col("doc_id") / 5).alias("call"), F.col("doc_id").alias("place"), "id", "source", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), "content")
    return tools.rendered_chunks(rows.select("call").distinct(), rows.where("place % 15 < 10"))


@query(
    """SELECT event_id AS call, CASE WHEN event_id % 3 = 0 THEN '{"kind":"semantic","tool":"search_docs","query":"' || coalesce(nullif(event_type, 'error'), '') || '","chunks":[{"citation":"docs:a#' || event_id || '","source":"docs","path":"a","score":0.5}]}'
    ELSE '{"kind":"structured","tool":"merged_prs","window":' || CASE WHEN event_id % 3 = 1 THEN '["2024-01-01","2024-02-01"]' ELSE 'null' END || ',"area":' || CASE event_type WHEN 'error' THEN 'null' ELSE '"' || event_type || '"' END || ',"count":' || CASE WHEN event_id % 3 = 1 THEN event_id ELSE 1 END
        || ',"entities":[{"citation":"pr:' || event_id || '","kind":"pr","ref":"' || event_id || '","title":"PR","author":"a","state":"open","at":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"2024-01-05"' END || ',"url":"/pr/' || event_id || '"}]}' END AS payload
    FROM events WHERE event_type <> 'signup' AND event_id % 5 <> 0"""
)
def retrieval_events(s, d):
    """Events as calls: passages, complete sets with a window, and things looked up; every fifth was an error."""
    i, t = F.col("event_id"), F.col("event_type")
    name, good = i.cast("string"), i % 5 != 0
    kind = F.when(t != "error", t)
    chunk = F.struct(F.concat(F.lit("docs:a#"), name).alias("citation"), F.lit("docs").alias("source"), F.lit("a").alias("path"), F.lit(0.5000000001).alias("score"))
    thing = F.struct(
        F.concat(F.lit("pr:"), name).alias("citation"), F.lit("pr").alias("kind"), name.alias("ref"), F.lit("PR").alias("title"), F.lit("a").alias("author"), F.lit("open").alias("state"), F.when(i % 2 == 1, "2024-01-05").alias("at"), F.concat(F.lit("/pr/"), name).alias("url")
    )
    rows = read(s, d, "events").select(
        i.alias("call"), F.when(t == "signup", "memory_search").when(i % 3 == 0, "search_docs").otherwise("merged_prs").alias("tool"), kind.alias("query"), kind.alias("area"), F.when(good & (i % 3 == 0), F.array(chunk)).alias("chunks"),
        F.when(good & (i % 3 > 0), F.array(thing)).alias("entities"), F.when(i % 3 == 1, i).alias("n"), F.when(i % 3 == 1, F.array(F.lit("2024-01-01"), F.lit("2024-02-01"))).alias("window"),
    )
    return tools.retrieval_events(rows)


# --- landed payloads ----------------------------------------------------------


def landed_commits(s, d):
    """Events as commits of a service: two files each, one of them twice."""
    k, i = F.get_json_object("props", "$.k"), F.col("event_id").cast("string")
    file = lambda path: F.struct(path.alias("filename"))
    return read(s, d, "events").select(
        F.sha2(i, 256).alias("sha"),
        F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.struct(F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("login"))).alias("author"),
        F.struct(F.concat("event_type", F.lit(" (#"), k, F.lit(")")).alias("message"), F.struct(F.concat(F.lit("git"), i).alias("name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date")).alias("author")).alias("commit"),
        F.array(file(F.concat("event_type", F.lit(".py"))), file(F.concat(F.lit("k"), k)), file(F.concat(F.lit("k"), k))).alias("files"),
    )


@query(
    """SELECT sha256(event_id::VARCHAR) AS sha, CASE event_id % 3 WHEN 0 THEN 'git' || event_id WHEN 1 THEN 'user' || user_id ELSE 'ghost' END AS author, date_trunc('second', ts)::TIMESTAMP AS committed_at,
    o_orderkey AS pr_number FROM events LEFT JOIN orders ON o_orderkey = json_extract_string(props, '$.k')::BIGINT"""
)
def commit_rows(s, d):
    return ingest.commit_rows(landed_commits(s, d), model.pull_requests(s, d)).select("sha", "author", "committed_at", "pr_number")


@query("SELECT DISTINCT sha, path FROM (SELECT sha256(event_id::VARCHAR) AS sha, unnest([event_type || '.py', 'k' || json_extract_string(props, '$.k')]) AS path FROM events)")
def commit_files(s, d):
    return ingest.commit_files(landed_commits(s, d))


def landed_prs(s, d):
    lines = read(s, d, "lineitem")
    file = F.struct(F.concat(F.lit("f"), (F.col("l_partkey") % 5).cast("string")).alias("filename"), F.col("l_linenumber").alias("additions"), F.lit(1).alias("deletions"))
    when = F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    review = F.struct(F.struct(F.concat(F.lit("sup"), F.col("l_suppkey").cast("string")).alias("login")).alias("user"), when.alias("submitted_at"), F.lit("APPROVED").alias("state"))
    return lines.groupBy(F.col("l_orderkey").alias("number")).agg(F.collect_list(file).alias("files"), F.collect_list(review).alias("reviews"))


@query("SELECT l_orderkey AS pr_number, 'f' || l_partkey % 5 AS path, sum(l_linenumber)::BIGINT AS additions, count(*) AS deletions FROM lineitem GROUP BY 1, 2")
def pr_file_details(s, d):
    return ingest.detail_rows(landed_prs(s, d))["pr_files"].select("pr_number", "path", F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"))


@query("SELECT DISTINCT l_orderkey AS pr_number, 'sup' || l_suppkey AS reviewer, l_shipdate AS submitted_at, 'approved' AS state FROM lineitem WHERE l_linenumber % 2 = 0")
def pr_review_details(s, d):
    return ingest.detail_rows(landed_prs(s, d))["pr_reviews"]


@query(
    """SELECT user_id AS run_id, min(ts) FILTER (event_type = 'signup') AS started_at, min(ts) FILTER (event_type = 'purchase') AS completed_at, max_by('n' || event_id, ts) FILTER (event_type IN ('purchase', 'view')) AS stats
    FROM events WHERE event_type IN ('signup', 'purchase', 'view') GROUP BY 1"""
)
def run_bookkeeping(s, d):
    op = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete").otherwise("stats")
    rows = read(s, d, "events").where("event_type in ('signup', 'purchase', 'view')")
    stats = F.when(F.col("event_type") != "signup", F.concat(F.lit("n"), F.col("event_id").cast("string")))
    return ingest.run_events(rows.select(F.col("user_id").alias("run_id"), op.alias("op"), F.col("ts").alias("at"), stats.alias("stats")))


@query("SELECT o_orderkey AS number, o_orderpriority AS milestone, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate END AS at, CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('month', o_orderdate)::TIMESTAMP END AS floor FROM orders")
def payload_fields(s, d):
    """Titles of milestones and times of payloads; empty and senseless times are none."""
    text = F.when(F.col("o_orderkey") % 3 < 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 2 == 0, "").otherwise("2026-02-31T00:00:00Z")
    rows = read(s, d, "orders").select(F.col("o_orderkey").alias("number"), F.struct(F.col("o_orderpriority").alias("title")).alias("m"), ingest.instant(text).alias("at"), F.date_trunc("month", "o_orderdate").alias("month"))
    floor = F.when(F.col("number") % 3 == 0, ingest.day_floor(F.col("month").cast("timestamp_ntz") + F.expr("INTERVAL 5 HOURS")))
    return rows.select("number", ingest.milestone(F.col("m")).alias("milestone"), "at", floor.alias("floor"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 10 IN (1, 2)")
def pending_embeddings(s, d):
    new, old = delta_sides(s, d)
    return sync.pending(new, sync.delta(new, old)).select("id")


# --- turns and suites ---------------------------------------------------------


def agent_events(s, d):
    """Events as those of turns, one for each user: calls that find the event's number and the user's."""
    e, i = read(s, d, "events"), F.col("event_id")
    kind = F.when(i % 7 == 0, "tools_selected").when(i % 7 == 1, "citation").when(i % 2 == 0, "structured").otherwise("semantic")
    cite = lambda n: F.concat(F.lit("c"), (n % 9).cast("string"))
    return e.select(
        F.col("user_id").alias("qid"), i.alias("seq"), kind.alias("event"), F.col("event_type").alias("tool"), F.array(cite(i), cite(F.col("user_id"))).alias("citations"), (i % 3 > 0).alias("resolved"), (i % 5 > 0).alias("in_result_set"), F.array("event_type", F.lit("memory_search")).alias("names")
    )


def agent_questions(s, d):
    users = read(s, d, "events").select(F.col("user_id").alias("qid")).distinct()
    users = users.union(users.select(F.col("qid") + 1_000_000))  # and as many of which no event tells
    return users.select("qid", (F.col("qid") % 6 + 1).alias("class"), F.array(F.lit("view")).alias("gold_tools"), F.array(F.lit("c1"), F.concat(F.lit("c"), (F.col("qid") % 9).cast("string"))).alias("gold"))


@query(
    """WITH e AS (SELECT user_id AS qid, event_id AS i, event_type AS tool, ['c' || event_id % 9, 'c' || user_id % 9] AS c, CASE WHEN event_id % 7 = 0 THEN 'sel' WHEN event_id % 7 = 1 THEN 'cite' WHEN event_id % 2 = 0 THEN 'struct' ELSE 'sem' END AS k FROM events),
    t AS (SELECT qid, coalesce(list_distinct(list(tool) FILTER (k = 'sel')), []) AS sel, avg((i % 3 > 0 AND i % 5 > 0)::INT) FILTER (k = 'cite') AS citation_resolution,
        coalesce(list_distinct(flatten(list(c) FILTER (k = 'struct'))), []) AS u, coalesce(list_distinct(flatten(list(c) FILTER (k = 'struct' AND tool = 'view'))), []) AS a, coalesce(flatten(list(c ORDER BY i) FILTER (k = 'sem')), []) AS sem FROM e GROUP BY 1 UNION ALL SELECT DISTINCT qid + 1000000, [], NULL, [], [], [] FROM e),
    p AS (SELECT *, qid % 6 + 1 AS class, list_distinct(['c1', 'c' || qid % 9]) AS g, list_filter(sem, lambda x, j: list_position(sem, x) = j) AS ps FROM t)
    SELECT qid, class, round(CASE WHEN list_contains(sel, 'view') THEN 1.0 / len(sel) ELSE 0 END, 6)::DOUBLE AS tool_jaccard, (sel = ['view'])::INT::DOUBLE AS tool_exact, round(citation_resolution, 6) AS citation_resolution,
    CASE WHEN class <= 4 THEN round(2.0::DOUBLE * len(list_intersect(a, g)) / (len(a) + len(g)), 6) END AS set_f1, CASE WHEN class <= 4 THEN round(2.0::DOUBLE * len(list_intersect(u, g)) / (len(u) + len(g)), 6) END AS set_f1_union,
    CASE WHEN class > 4 THEN round(len(list_intersect(ps[1:5], g)) / len(g)::DOUBLE, 6) END AS recall_at_5,
    CASE WHEN class > 4 THEN round(coalesce(1.0::DOUBLE / list_min(list_filter(range(1, 11), lambda j: j <= len(ps) AND list_contains(g, ps[j]))), 0), 6) END AS mrr_at_10 FROM p"""
)
def turn_scores(s, d):
    scores = evals.turn_scores(agent_events(s, d), agent_questions(s, d)).drop("failed")
    return scores.select("qid", F.col("class").cast("long").alias("class"), *(F.round(c, 6).alias(c) for c in scores.columns[2:]))


@query("SELECT DISTINCT user_id AS qid FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0 AND event_type = 'view') UNION ALL SELECT DISTINCT user_id + 1000000 FROM events")
def resumed_run(s, d):
    cache = read(s, d, "events").select(F.col("user_id").alias("qid"), (F.col("event_id") % 2).cast("int").alias("cache_format"), F.when(F.col("event_type") != "view", "failed").alias("error"))
    return evals.left_to_run(agent_questions(s, d), cache, 0).select("qid")


@query(
    """WITH s AS (SELECT conv_id AS place, CASE WHEN conv_id % 10 = 7 THEN NULL WHEN conv_id % 10 = 9 THEN conv_id - 1 ELSE conv_id END::VARCHAR AS id, turn, role, CASE WHEN conv_id % 6 = 2 AND turn = 1 THEN '' ELSE text END AS text, conv_id % 4 AS tool, ['e', NULL, ''][conv_id % 3 + 1] AS area, CASE WHEN conv_id % 5 = 1 THEN 'A' END AS since, conv_id % 7 AS hint FROM conversations),
    n AS (SELECT *, coalesce(id, '<no id>') AS scenario, row_number() OVER (PARTITION BY place ORDER BY turn, role, text) - 1 AS session, count(*) OVER (PARTITION BY place) AS n FROM s), l AS (SELECT * FROM n WHERE session = n - 1)
    SELECT scenario, 'no id' AS error FROM l WHERE id IS NULL UNION ALL SELECT scenario, 'sessions: ' || n FROM l WHERE n <> 3 UNION ALL SELECT scenario, 'no prompt in session ' || session + 1 FROM n WHERE coalesce(text, '') = '' UNION ALL SELECT scenario, 'the last session expects no tool' FROM l WHERE tool < 2
    UNION ALL SELECT scenario, 'the last session has no clarification' FROM l WHERE hint < 2 UNION ALL SELECT scenario, 'the last session names its area' FROM l WHERE area <> '' AND contains(lower(text), area) UNION ALL SELECT scenario, 'the last session names its time' FROM l WHERE since IS NOT NULL AND contains(lower(text), 'a')
    UNION ALL SELECT id, 'repeated id' FROM s WHERE id IS NOT NULL GROUP BY id HAVING count(DISTINCT place) > 1"""
)
def suite_validate(s, d):
    """Each conversation as a scenario, its turns as sessions; ids are missing or repeated, too."""
    i = F.col("conv_id")
    of = lambda n, values: F.get(F.array(*map(F.lit, values)), (i % n).cast("int"))
    text = F.when((i % 6 == 2) & (F.col("turn") == 1), "").otherwise(F.col("text"))
    rows = read(s, d, "conversations").select("conv_id", "turn", "role", text.alias("text"))
    session = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    name = F.when(i % 10 != 7, F.when(i % 10 == 9, i - 1).otherwise(i)).cast("string")
    expected = (of(4, (None, "", "a", "b")).alias("tool"), of(3, ("e", None, "")).alias("area"), F.when(i % 5 == 1, "A").alias("since"), of(7, (None, "", "x", "x", "x", "x", "x")).alias("clarification"))
    return evals.suite_errors(rows.select(i.alias("place"), name.alias("scenario"), session.alias("session"), F.col("text").alias("prompt"), *expected))


def session_log(s, d):
    """Every tenth event is a session of its user that there is; the others ask for one: theirs, one that there isn't, or a new one."""
    e = read(s, d, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), "ts")
    name = F.concat(F.lit("sess_"), F.col("event_id").cast("string"))
    there = e.where("event_id % 10 = 0").select(name.alias("id"), "user_id", F.col("ts").alias("started_at"), F.when(F.col("event_id") % 20 == 0, F.col("ts")).alias("ended_at"))
    other = F.concat(F.lit("sess_"), (F.col("event_id") - F.col("event_id") % 10).cast("string"))
    asked = F.when(F.col("event_id") % 10 < 4, other).when(F.col("event_id") % 10 == 4, F.concat(F.lit("lost_"), F.col("user_id"))).when(F.col("event_id") % 10 == 5, "")
    return there, e.where("event_id % 10 <> 0").select(F.col("event_id").alias("request"), "user_id", asked.alias("session_id"), F.col("ts").alias("at"))


def new_session():
    return F.concat(F.lit("sess_"), F.col("request").cast("string"))


@query(
    """SELECT event_id AS request, CASE WHEN event_id % 10 < 4 THEN 'sess_' || event_id // 10 * 10 WHEN event_id % 10 > 4 THEN 'sess_' || event_id END AS session_id, event_id % 10 > 4 AS created,
    CASE WHEN event_id % 10 = 4 THEN 'no session lost_' || user_id END AS error FROM events WHERE event_id % 10 <> 0"""
)
def session_resolve(s, d):
    there, requests = session_log(s, d)
    return sessions.resolved(there, requests, new_session())[1]


@query(
    """WITH s AS (SELECT event_id, ts, CASE WHEN event_id % 20 = 0 THEN ts END AS ended FROM events WHERE event_id % 10 IN (0, 5, 6, 7, 8, 9))
    SELECT 'sess_' || event_id AS id, coalesce(ended, CASE WHEN event_id % 4 = 2 THEN ts + INTERVAL 1 HOUR END) AS ended_at FROM s"""
)
def session_end(s, d):
    """The batch of requests and its endings, both twice: sessions are made once and end by their first ending."""
    there, requests = session_log(s, d)
    every, _ = sessions.resolved(there, requests, new_session())
    every, _ = sessions.resolved(every, requests, new_session())
    number = F.split_part("id", F.lit("_"), F.lit(2)).cast("long")
    ends = lambda hours: every.where(number % 4 == 2).select(F.col("id").alias("session_id"), (F.col("started_at") + F.make_dt_interval(F.lit(0), F.lit(hours))).alias("at"))
    once, _ = sessions.ended(every, ends(2).union(ends(1)).union(ends(1).withColumn("session_id", F.lit("lost"))))
    return sessions.ended(once, ends(3))[0].select("id", "ended_at")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'query: ' WHEN 'de' THEN 'Represent: ' ELSE '' END || text AS asked, CASE lang WHEN 'en' THEN 'passage: ' ELSE '' END || text AS stored FROM documents")
def prefixed_texts(s, d):
    prefixes = {"en": ("query: ", "passage: "), "de": ("Represent: ", "")}
    return read(s, d, "documents").select("doc_id", evals.prefixed(F.col("text"), F.col("lang"), prefixes, True).alias("asked"), evals.prefixed(F.col("text"), F.col("lang"), prefixes, False).alias("stored"))


@query("SELECT floor(p * 500) AS full, floor(p * 0.25 * 500 + 40 / 3.5::DOUBLE) AS native FROM (SELECT floor(sum(length(text)) / 3.5::DOUBLE) / count(*) AS p FROM documents)")
def prompt_totals(s, d):
    out = evals.prompt_totals(read(s, d, "documents").select(F.length("text").alias("chars")), F.lit(500))
    return out.select(F.col("full").cast("double").alias("full"), F.col("native").cast("double").alias("native"))


@query(f"WITH {MEM} SELECT user_id AS cluster, string_agg('[' || id || '] ' || content, chr(10) ORDER BY valid_from, id) AS text FROM memories GROUP BY 1")
def render_cluster(s, d):
    return memory.rendered_cluster(memories(s, d).select(F.col("user_id").alias("cluster"), "id", "valid_from", "content"))


@query(f"WITH {MEM}, live AS (SELECT * FROM memories WHERE valid_to IS NULL AND mem_type = 'episodic') SELECT user_id, count(*) AS live, count(*) FILTER (id % 2 = 0) // 2 AS clusters, count(*) FILTER (id % 2 = 0) // 2 * 2 AS clustered, count(*) - count(*) FILTER (id % 2 = 0) // 2 * 2 AS unclustered FROM live GROUP BY 1")
def consolidation_dry_run(s, d):
    """Pairs of even memories stand for clusters."""
    m = memories(s, d)
    even = m.where("valid_to is null and mem_type = 'episodic' and id % 2 = 0").groupBy("user_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = even.select("user_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("ids") / 2).cast("int")), lambda i: F.slice("ids", i * 2 + 1, 2))).alias("members")).where("size(members) = 2")
    rows = memory.dry_run(m, pairs)
    return rows.select("user_id", "live", *(F.col(c).cast("long").alias(c) for c in ("clusters", "clustered", "unclustered")))


@query(
    f"""WITH {MEM}, found AS (SELECT id // 15 AS call, '**From memory:**' || chr(10) || chr(10) || string_agg('- [procedural] ' || content, chr(10) ORDER BY id) AS text FROM memories WHERE mem_type = 'procedural' AND valid_to IS NULL AND id // 15 % 2 = 0 GROUP BY 1)
    SELECT call, coalesce(text, '**Nothing in memory matches that.**') AS text FROM (SELECT DISTINCT id // 15 AS call FROM memories) LEFT JOIN found USING (call)"""
)
def render_memories(s, d):
    rows = memories(s, d).withColumns({"place": F.col("id"), "call": F.floor(F.col("id") / 15)})
    return tools.rendered_memories(rows.select("call").distinct(), rows.where("mem_type = 'procedural' and valid_to is null and call % 2 = 0"), F.lit(NOW))
