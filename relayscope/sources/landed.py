"""Landed responses of a service: lines of JSON with a kind, a reference and a page of payloads.

Read by Spark's own readers, so that any store will do. Nothing is dropped in
silence: a line or payload that can't be used is kept with the reason, and a
page that landed twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from relayscope.operators import ingest

USER, CORRUPT = "user struct<login:string>", "_corrupt"
#: The fields of payloads that are read, their key, and what tells versions of one apart.
KINDS: dict[str, tuple[str, str, str | None]] = {
    "pull": (f"number long, title string, body string, state string, draft boolean, {USER}, created_at string, updated_at string, merged_at string, closed_at string, milestone struct<title:string>, html_url string", "number", "updated_at"),
    "issue": (f"number long, title string, body string, state string, {USER}, created_at string, updated_at string, closed_at string, milestone struct<title:string>, labels array<struct<name:string>>, pull_request string, html_url string", "number", "updated_at"),
    "commit": ("sha string, author struct<login:string>, commit struct<message:string,author:struct<name:string,date:string>,committer:struct<date:string>>, files array<struct<filename:string>>", "sha", None),
    "release": ("tag_name string, name string, published_at string, created_at string, html_url string", "tag_name", None),
    "comment": (f"id long, {USER}, body string, created_at string", "id", None),
}


def parsed(text: Column, schema: str) -> Column:
    return F.from_json(text, f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """file, kind, ref, text, reason of every payload below ``path``; a line without payloads that can be used is one itself."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value", parsed(F.col("value"), "kind string, ref string, page array<string>").alias("e"))
    broken = F.col("e").isNull() | F.col(f"e.{CORRUPT}").isNotNull()
    reason = F.when(broken, "no JSON").when(F.col("e.kind").isNull(), "no kind").when(~F.col("e.kind").isin(*KINDS), "unknown kind").when(F.col("e.page").isNull(), "no page")
    told = rows.where(F.trim("value") != "").withColumn("reason", reason)
    whole = F.when(F.col("reason").isNotNull(), F.array("value")).otherwise(F.col("e.page"))
    return told.select("file", F.col("e.kind").alias("kind"), F.col("e.ref").alias("ref"), F.explode(whole).alias("text"), "reason").withColumn("reason", judged(F.col("kind"), F.col("text"), F.col("reason")))


def judged(kind: Column, text: Column, reason: Column) -> Column:
    """The reason, or why a payload of its kind can't be used."""
    for name, (schema, key, version) in KINDS.items():
        x = parsed(text, f"{key} string" + (f", {version} string" if version else ""))
        wrong = F.when(x.isNull() | x[CORRUPT].isNotNull(), "no JSON").when(x[key].isNull(), F.lit(f"no {key}"))
        if version:
            wrong = wrong.when(ingest.instant(x[version]).isNull(), F.lit(f"no {version}"))
        reason = F.when(reason.isNull() & (kind == name), wrong).otherwise(reason)
    return reason


def records(rows: DataFrame, kind: str) -> DataFrame:
    """The payloads of a kind with their fields and ref, of each key the last version; the same one twice is one."""
    schema, key, version = KINDS[kind]
    good = rows.where((F.col("kind") == kind) & F.col("reason").isNull()).select("ref", "text").distinct()
    last = good.select("ref", "text", parsed(F.col("text"), schema).alias("r"))
    keys = [F.col(f"r.{key}").alias("key")] + ([F.col("ref").alias("of")] if kind == "comment" else [])
    order = F.struct(*([F.col(f"r.{version}").alias("version")] if version else []), F.col("text"))
    newest = last.groupBy(*keys).agg(F.max_by(F.struct("ref", "r"), order).alias("x")).select("x.ref", "x.r.*")
    return newest.drop(CORRUPT)


def issue_comments(rows: DataFrame) -> DataFrame:
    """issue, id, author, body, at of the landed comments; the reference of their page is the issue's number."""
    return records(rows, "comment").select(F.col("ref").try_cast("long").alias("issue"), "id", ingest.login(F.col("user")).alias("author"), "body", ingest.instant(F.col("created_at")).alias("at"))


def releases(rows: DataFrame) -> DataFrame:
    """tag, name, published_at, url of the landed releases."""
    made = records(rows, "release").withColumns({"published_at": ingest.instant(F.col("published_at")), "created_at": ingest.instant(F.col("created_at"))})
    return made.select(F.col("tag_name").alias("tag"), "name", F.coalesce("published_at", "created_at").alias("published_at"), F.col("html_url").alias("url"))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The facts layer's tables of what landed: pull_requests, issues without those that are pull requests, issue_labels, commits, commit_files, releases."""
    at = lambda name: ingest.instant(F.col(name)).alias(name)
    common = ("number", "title", ingest.login(F.col("user")).alias("author"))
    ended = (at("created_at"), at("closed_at"), ingest.milestone(F.col("milestone")).alias("milestone"), F.col("html_url").alias("url"))
    pulls, issues, commits = records(rows, "pull"), ingest.only_issues(records(rows, "issue")), records(rows, "commit")
    prs = pulls.select(*common, ingest.pr_state(ingest.instant(F.col("merged_at")), F.col("state")).alias("state"), F.coalesce("draft", F.lit(False)).alias("is_draft"), at("merged_at"), *ended)
    labels = issues.select(F.col("number").alias("issue_number"), F.explode(F.array_distinct("labels.name")).alias("label")).where("label is not null")
    return {
        "pull_requests": prs,
        "issues": issues.select(*common, F.when(F.col("state") == "closed", "closed").otherwise("open").alias("state"), *ended),
        "issue_labels": labels,
        "commits": ingest.commit_rows(commits, prs),
        "commit_files": ingest.commit_files(commits),
        "releases": releases(rows),
    }


#: Each table's key, and of a child table its parent.
KEYS = {"pull_requests": ("number", None), "issues": ("number", None), "issue_labels": ("issue_number", "issues"), "commits": ("sha", None), "commit_files": ("sha", "commits"), "releases": ("tag", None)}


def stored_after(stored: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The stored tables after those of a run: rows are replaced by key, children of what the run has as a whole, even by none."""
    out = {}
    for name, (key, parent) in KEYS.items():
        if parent is None:
            out[name] = ingest.upserted(stored[name], fresh[name], [key])
        else:
            out[name] = ingest.with_children(stored[name], fresh[name], fresh[parent].select(F.col(KEYS[parent][0]).alias(key)), key)
    return out


def pinned(rows: DataFrame, ref: str) -> DataFrame:
    """sha, committed_at of the commit that a symbolic reference, the reference of its page, stands for; raises if none landed."""
    found = records(rows.where(F.col("ref") == ref), "commit").select("sha", ingest.instant(F.col("commit.committer.date")).alias("committed_at"))
    if found.isEmpty():
        raise LookupError(f"no commit landed for {ref!r}")
    return found.orderBy(F.desc("committed_at"), "sha").limit(1)


def counts(rows: DataFrame) -> DataFrame:
    """kind, reason, n, files: payloads by what became of them; a null reason is those that can be used, each once."""
    once = rows.groupBy("kind", "reason", "ref", "text").agg(F.min("file").alias("file"))
    return once.groupBy("kind", "reason").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def ingested(spark: SparkSession, path: str, quarantine: str) -> tuple[DataFrame, dict[str, int]]:
    """The payloads below ``path``, and payloads, used and left of one pass, which writes those that can't be used (file, kind, text, reason) to ``quarantine``."""
    seen = Observation("landed")
    good = F.col("reason").isNull()
    rows = payloads(spark, path)
    watched = rows.observe(seen, F.count("*").alias("payloads"), F.count_if(good).alias("used"), F.count_if(~good).alias("left"))
    watched.where(~good).select("file", "kind", "text", "reason").write.mode("overwrite").parquet(quarantine)
    return rows, seen.get
