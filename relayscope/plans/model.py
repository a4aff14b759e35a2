"""The model's tables, made of the given ones: the only place that knows both.

Each table is here twice: as a DataFrame, and as a common table expression for
the oracle. Prices of orders, say, don't matter; what matters is that states,
dates, paths and labels take all the values that the operators tell apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: F is merged, O open, P closed without a merge."""
    o = read(spark, sf_dir, "orders")
    status, at = F.col("o_orderstatus"), F.col("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("number"),
        F.concat(F.lit("PR "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("author"),
        F.when(status == "F", "merged").when(status == "O", "open").otherwise("closed").alias("state"),
        at.alias("created_at"),
        F.when(status == "F", at).alias("merged_at"),
        F.when(status.isin("F", "P"), at).alias("closed_at"),
        (F.col("o_orderpriority") == "5-LOW").alias("is_draft"),
        F.col("o_orderpriority").alias("milestone"),
    )


def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of an order's lines: one row for each path of a pull request."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_type")).alias("path"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pr_number"), "l_partkey", F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").alias("deletions"))
    return lines.join(part, "l_partkey").groupBy("pr_number", "path").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def pr_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pr_number"), F.concat(F.lit("sup"), F.col("l_suppkey").cast("string")).alias("reviewer"), F.col("l_shipdate").alias("submitted_at"), F.col("l_returnflag").alias("state")
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    is_open = F.col("o_orderstatus") == "O"
    return o.select(
        F.col("o_orderkey").alias("number"),
        F.concat(F.lit("Issue "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("author"),
        F.when(is_open, "open").otherwise("closed").alias("state"),
        F.col("o_orderdate").alias("created_at"),
        F.when(~is_open, F.col("o_orderdate")).alias("closed_at"),
        F.col("o_orderpriority").alias("milestone"),
        F.col("o_custkey"),
    )


def issue_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's segment and the priority, of each issue."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lower("c_mktsegment").alias("segment"))
    both = issues(spark, sf_dir).join(c, "o_custkey", "left").select("number", F.explode(F.array("segment", F.lower("milestone"))).alias("label"))
    return both.where("label is not null").select(F.col("number").alias("issue_number"), "label").distinct()


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events; the message ends its first line with the number of a pull request."""
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("sha"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
        F.concat("event_type", F.lit(" (#"), k, F.lit(")\nbody (#999)")).alias("message"),
        F.col("ts").alias("committed_at"),
        F.concat("event_type", F.lit("/"), k, F.lit(".py")).alias("path"),
    )


def commit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a commit: its own path, and for every fourth another one; a file may come twice."""
    e = read(spark, sf_dir, "events")
    sha, k = F.sha2(F.col("event_id").cast("string"), 256).alias("sha"), F.get_json_object("props", "$.k")
    own = F.concat("event_type", F.lit("/"), k, F.lit(".py"))
    other = F.concat(F.get(F.array(F.lit("click"), F.lit("view"), F.lit("cold")), (F.col("event_id") % 3).cast("int")), F.lit("/shared.py"))
    return e.select(sha, F.explode(F.when(F.col("event_id") % 4 == 0, F.array(own, other, own)).otherwise(F.array(own))).alias("path"))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each quarter with orders, published on its first day."""
    q = read(spark, sf_dir, "orders").select(F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("published_at")).distinct()
    tag = F.concat(F.lit("v"), F.year("published_at").cast("string"), F.lit("."), F.quarter("published_at").cast("string"))
    return q.select(tag.alias("tag"), F.lit(None).cast("string").alias("name"), "published_at")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return read(spark, sf_dir, "documents").join(e, "doc_id").select(
        F.concat(F.lit("docs:"), F.col("source"), F.lit("#"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("source"), F.col("text").alias("content"), "embedding", "doc_id"
    )


# Areas and their globs.
AREAS = {"cold": ("cold/**", "blue/**"), "clicks": ("click/*",), "exact": ("view/1.py",), "views": ("view/**",), "any": ("_old/**",)}

MODEL_SQL = {
    "pull_requests": """SELECT o_orderkey AS number, 'PR ' || o_orderkey AS title, 'user' || o_custkey AS author,
        CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'closed' END AS state, o_orderdate AS created_at,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS merged_at, CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderdate END AS closed_at,
        o_orderpriority = '5-LOW' AS is_draft, o_orderpriority AS milestone FROM orders""",
    "pr_files": """SELECT l_orderkey AS pr_number, replace(p_name, ' ', '/') || '/' || p_type AS path,
        sum(l_quantity::BIGINT)::BIGINT AS additions, sum(l_linenumber)::BIGINT AS deletions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "pr_reviews": "SELECT l_orderkey AS pr_number, 'sup' || l_suppkey AS reviewer, l_shipdate AS submitted_at, l_returnflag AS state FROM lineitem",
    "issues": """SELECT o_orderkey AS number, 'Issue ' || o_orderkey AS title, 'user' || o_custkey AS author, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state,
        o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS closed_at, o_orderpriority AS milestone, o_custkey FROM orders""",
    "issue_labels": """SELECT DISTINCT o_orderkey AS issue_number, label FROM (SELECT o_orderkey, lower(o_orderpriority) AS label FROM orders
        UNION ALL SELECT o_orderkey, lower(c_mktsegment) FROM orders JOIN customer ON o_custkey = c_custkey) WHERE label IS NOT NULL""",
    "commits": """SELECT sha256(event_id::VARCHAR) AS sha, 'user' || user_id AS author, event_type || ' (#' || json_extract_string(props, '$.k') || ')' || chr(10) || 'body (#999)' AS message,
        ts AS committed_at, event_type || '/' || json_extract_string(props, '$.k') || '.py' AS path FROM events""",
    "commit_paths": """SELECT sha256(event_id::VARCHAR) AS sha, event_type || '/' || json_extract_string(props, '$.k') || '.py' AS path FROM events
        UNION ALL SELECT sha256(event_id::VARCHAR), ['click', 'view', 'cold'][event_id % 3 + 1] || '/shared.py' FROM events WHERE event_id % 4 = 0""",
    "releases": """SELECT DISTINCT 'v' || year(o_orderdate) || '.' || quarter(o_orderdate) AS tag, NULL::VARCHAR AS name, date_trunc('quarter', o_orderdate)::TIMESTAMP AS published_at FROM orders""",
    "chunks": """SELECT 'docs:' || source || '#' || doc_id AS id, lang AS source, text AS content, embedding, doc_id FROM documents JOIN embeddings ON doc_id = vec_id""",
}


def sql(query: str, *tables: str) -> str:
    """``query`` with the model's tables that it reads in front."""
    ctes = ",\n".join(f"{t} AS ({MODEL_SQL[t]})" for t in tables)
    head = query.lstrip()
    return f"WITH {ctes}, {head[5:]}" if head.upper().startswith("WITH ") else f"WITH {ctes}\n{query}"
