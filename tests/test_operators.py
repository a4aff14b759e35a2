from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relayscope.operators import evals, facts, ingest, memory, metrics, retrieval, sync, tools, turns
from relayscope.sources import sets, tree
from relayscope.sources.tree import classified

D = datetime


def values(df):
    return sorted(tuple(r) for r in df.collect())


def prs(spark):
    rows = [
        (1, "merged", D(2024, 1, 1), D(2024, 2, 1), D(2024, 2, 1), False),
        (2, "merged", D(2024, 1, 1), D(2024, 3, 1), D(2024, 3, 1), False),
        (3, "open", D(2024, 1, 1), None, None, False),
        (4, "open", D(2024, 1, 1), None, None, True),
        (5, "open", D(2024, 2, 1), None, None, False),
    ]
    return spark.createDataFrame(rows, "number long, state string, created_at timestamp_ntz, merged_at timestamp_ntz, closed_at timestamp_ntz, is_draft boolean")


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "pr_number long, path string")


def test_merged_windows_are_half_open(spark):
    got = facts.merged_prs(prs(spark), files(spark, (1, "a")), D(2024, 2, 1), D(2024, 3, 1))
    assert values(got.select("number")) == [(1,)]


def test_an_area_counts_a_row_once_and_underscore_is_a_wildcard(spark):
    f = files(spark, (1, "tests/testXsecurity_a.py"), (1, "tests/test_security_b.py"), (2, "other.py"))
    got = facts.merged_prs(prs(spark), f, D(2024, 1, 1), D(2025, 1, 1), ["tests/test_security*"])
    assert values(got.select("number")) == [(1,)]
    with pytest.raises(facts.UnknownArea, match="cold"):
        facts.area_globs({"cold": []}, "warm")
    assert facts.area_patterns(["a/**", "b/*", "c.py", "d/*/e"]) == ["a/%", "b/%", "c.py%", "d/*/e%"]


def test_stale_boundaries(spark):
    reviews = spark.createDataFrame([(3, D(2024, 2, 1)), (4, D(2024, 2, 2))], "pr_number long, submitted_at timestamp_ntz")
    assert values(facts.stale_prs(prs(spark), reviews, D(2024, 2, 1)).select("number")) == [(3,)]
    later = spark.createDataFrame([(3, D(2024, 2, 1, 0, 0, 1))], "pr_number long, submitted_at timestamp_ntz")
    assert values(facts.stale_prs(prs(spark), later, D(2024, 2, 1)).select("number")) == []


def test_unknown_release_is_named(spark):
    releases = spark.createDataFrame([("v1", D(2024, 1, 1))], "tag string, published_at timestamp_ntz")
    with pytest.raises(facts.UnknownRelease, match="v9"):
        facts.release_diff(prs(spark), releases, "v1", "v9")


def test_rendering_counts_all(spark):
    found = spark.range(60).select(F.format_string("t%02d", "id").alias("title"), F.format_string("pr:%02d", "id").alias("citation"), F.lit("me").alias("author"), F.lit(D(2024, 3, 5)).alias("at"))
    row = facts.rendered(found, "Merged", [F.desc("citation")], "cold", ["a/**", "b"]).first()
    assert row["n"] == 60 and row["rendered"].startswith("**Merged: 60**\n_area `cold` resolved to: a/**, b_\n\n- `pr:59` 2024-03-05 — @me — t59\n") and row["rendered"].endswith("\n- …and 10 more (not listed)")
    bare = found.limit(1).select("title", "citation", F.lit("").alias("author"), F.lit(None).cast("timestamp").alias("at"))
    assert facts.rendered(bare, "Open", ["citation"]).first()["rendered"] == "**Open: 1**\n\n- `pr:00` — — t00"
    assert facts.rendered(found.limit(0), "Open", ["citation"]).first()["rendered"] == "**Open: 0**\n\n(none)"


def test_ingest_texts(spark):
    bodies = {"It fixes #70.": [70], "RESOLVED : #8, closing #9": [8], "close  #3 and close #3\nResolve: #12": [3, 12], "prefixes #4 and fix#5": [], "Fixed #123456789012345678901": [], None: []}
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select(F.array_sort(ingest.closing_refs(F.col("b"))))
    assert [r[0] for r in rows.collect()] == list(bodies.values())
    messages = {"Add a reader (#55)": 55, "Add (#1) and more (#2)  \nbody (#3)": 2, "Add (#5) at last": None, "(#99999999999999999999)": None, "": None}
    rows = spark.createDataFrame([(m,) for m in messages], "m string").select(ingest.commit_pr_number(F.col("m")))
    assert [r[0] for r in rows.collect()] == list(messages.values())


def test_payload_rows(spark):
    kind = "sha string, author struct<login:string>, commit struct<message:string,author:struct<name:string,date:string>>, files array<struct<filename:string>>"
    rows = [("s1", None, ("x (#1)", ("git", "2024-01-02T03:04:05Z")), [("a",), ("a",), ("b",)]), ("s2", (None,), ("y (#77)", ("git", "soon")), []), ("s3", ("me",), ("z", ("git", None)), None)]
    commits = spark.createDataFrame(rows, kind)
    assert values(ingest.commit_files(commits)) == [("s1", "a"), ("s1", "b")]
    got = {r["sha"]: (r["author"], r["pr_number"], r["committed_at"]) for r in ingest.commit_rows(commits, prs(spark)).collect()}
    assert got == {"s1": ("git", 1, D(2024, 1, 2, 3, 4, 5)), "s2": ("ghost", None, None), "s3": ("me", None, None)}
    listed = spark.createDataFrame([(1, None), (2, "x")], "number long, pull_request string")
    assert values(ingest.only_issues(listed).select("number")) == [(1,)]
    releases = spark.createDataFrame([("v1", None, None, D(2024, 1, 1)), ("v2", "Two", D(2024, 2, 2), D(2024, 1, 1))], "tag_name string, name string, published_at timestamp_ntz, created_at timestamp_ntz")
    assert values(ingest.release_rows(releases).select("tag", "published_at")) == [("v1", D(2024, 1, 1)), ("v2", D(2024, 2, 2))]
    areas = spark.createDataFrame([("a", ["x"]), ("a", ["y"])], "name string, globs array<string>")
    with pytest.raises(ValueError, match="twice: a"):
        ingest.areas_synced(areas, areas)
    stored = spark.createDataFrame([(1, "old"), (3, "kept")], "pr_number long, path string")
    fresh = spark.createDataFrame([(2, "new")], "pr_number long, path string")
    parents = spark.createDataFrame([(1,), (2,)], "pr_number long")
    assert values(ingest.with_children(stored, fresh, parents, "pr_number")) == [(2, "new"), (3, "kept")]


def test_only_closed_issues_are_linked_and_the_last_pr_wins(spark):
    p = spark.createDataFrame([(1, "closes #10, closes #11"), (2, "closes #10, closes #99")], "number long, body string")
    issues = spark.createDataFrame([(10, "closed"), (11, "open")], "number long, state string")
    assert values(ingest.closing_links(p, issues, "number")) == [(10, 2)]
    assert ingest.closing_links_dropped(p, issues, "number").first()[0] == 2


def test_walk(spark, tmp_path):
    cases = {
        "README.md": "docs",
        "docs/en/start.md": "docs",
        "docs/pt-br/start.md": "translated",
        "docs/fr/deep/er.py": "translated",
        "docs/guides/x.md": "docs",
        "lib/docs/fr/a.md": "docs",
        "site/index.md": "skipped",
        "lib/node_modules/m/a.py": "skipped",
        "mysite/a.py": "code",
        "data.csv": "unsupported",
    }
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select(classified(F.col("p")))
    assert [r[0] for r in rows.collect()] == list(cases.values())
    for p in cases:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"text of {p}")
    assert values(tree.checkout(spark, str(tmp_path)).select("path", "content", "kind")) == sorted((p, f"text of {p}", k) for p, k in cases.items() if k in ("docs", "code"))
    assert dict(values(tree.walk_counts(spark, str(tmp_path)))) == {"docs": 4, "code": 1, "skipped": 2, "translated": 2, "unsupported": 1}


def test_fusion(spark):
    arm = lambda *ids: spark.createDataFrame([(i, float(-k)) for k, i in enumerate(ids)], "id string, score double")
    got = dict(values(retrieval.fused(arm("p", "q", "r"), arm("r", "s"))))
    assert got == pytest.approx({"p": 1 / 61, "q": 1 / 62, "r": 1 / 63 + 1 / 61, "s": 1 / 62})


def test_places_of_tools_that_cannot_be_called_stay_empty(spark):
    rows = [("a", True, [1.0, 0.0]), ("b", False, [0.9, 0.1]), ("c", True, [0.8, 0.2]), ("z", True, [0.0, 1.0])]
    tools = spark.createDataFrame(rows, "name string, dispatchable boolean, embedding array<double>")
    got = retrieval.select_tools(tools, retrieval.vector([1, 0]), k=2, always=("z",))
    assert [r["name"] for r in got.orderBy("name").collect()] == ["a", "z"]


NOW = D(2026, 8, 26)


def memories(spark, rows):
    schema = "id string, user_id string, mem_type string, content string, entities array<string>, confidence double, revision int, valid_from timestamp_ntz, valid_to timestamp_ntz, created_by string, source_session_id string, source_ids array<string>, embedding array<double>"
    full = [(i, "u", kind, i, entities, conf, 1, NOW - timedelta(days=age), None, "agent", None, [], vec) for i, kind, entities, conf, age, vec in rows]
    return spark.createDataFrame(full, schema)


def test_recency_can_outrank_similarity(spark):
    m = memories(spark, [("old", "episodic", [], 1.0, 400, [1.0, 0.0]), ("new", "episodic", [], 1.0, 0, [1.0, 1.0])])
    rank = lambda half: [r["id"] for r in memory.ranked(m, "u", "episodic", retrieval.vector([1, 0]), F.lit(NOW), 5, half).collect()]
    assert rank(30) == ["new", "old"] and rank(None) == ["old", "new"]


def test_packing_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 5), (2, 50), (3, 1)], "id int, cost int").withColumn("g", F.lit(1))
    assert values(memory.packed(rows, 20, ["g"], ["id"]).select("id")) == [(1,)]


def test_revert_revives_and_tells_unknown_things_apart(spark):
    m = memory.superseded(memories(spark, [("a", "semantic", [], 1.0, 3, [1.0])]), "a", NOW)
    back = memory.reverted(m, "a", 1, NOW)
    assert values(back.select("revision", F.col("valid_to").isNull(), "created_by")) == [(1, False, "agent"), (2, True, "human")]
    with pytest.raises(LookupError, match="no memory"):
        memory.reverted(m, "b", 1, NOW)
    with pytest.raises(LookupError, match="no revision"):
        memory.reverted(m, "a", 7, NOW)


def test_clusters(spark):
    bent = lambda names, tags: [(n, "episodic", tags[i], 1.0, 1, [3.0, 0.2 * i, 0.1]) for i, n in enumerate(names)]
    members = lambda rows: sorted(r["members"] for r in memory.clusters(memories(spark, rows)).collect())
    assert members(bent("pqrs", [["k", "l"], ["k"], ["k", "m"], ["k"]])) == [list("pqrs")]
    assert members(bent("pqr", [["k"], ["k"], ["m"]])) == [] and members(bent("pqr", [["k"], [], ["k"]])) == [] and members(bent("pq", [["k"], ["k"]])) == []
    far = [(n, "episodic", ["k"], 1.0, 1, [0.1 * i, 0.0, 5.0]) for i, n in enumerate("uvw")]
    assert members(bent("pqr", [["k"]] * 3) + far) == [list("pqr"), list("uvw")]


def test_clusters_are_those_of_one_linkage_over_all(spark):
    import numpy as np

    numbers = np.random.default_rng(8)
    rows = [(f"m{i:02d}", "episodic", ["k"], 1.0, 1, [float(x) for x in numbers.normal(0, 1, 3)]) for i in range(40)]
    label = memory.average_linkage(np.array([r[5] for r in rows]))
    want = sorted([r[0] for r, x in zip(rows, label, strict=True) if x == c] for c in set(label.tolist()) if (label == c).sum() >= 3)
    assert sorted(r["members"] for r in memory.clusters(memories(spark, rows)).collect()) == want and want


def test_near_pairs_are_all_of_them(spark):
    import numpy as np

    numbers = np.random.default_rng(3)
    vectors = {("u" if i % 3 else "w", f"m{i:03d}"): numbers.normal(0, 1, 4) for i in range(150)}
    rows = spark.createDataFrame([(u, i, [float(x) for x in v]) for (u, i), v in vectors.items()] + [("u", "zero", [0.0] * 4)], "user_id string, id string, embedding array<double>")
    close = lambda x, y: 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y) < memory.LINKAGE
    want = sorted((u, i, j) for (u, i), x in vectors.items() for (w, j), y in vectors.items() if u == w and i < j and close(x, y))
    got = memory.near_pairs(rows, pivots=6, block=10)
    assert values(got) == want and len(want) > 100
    assert memory.near_pairs(rows.limit(0)).count() == 0


def test_writes_supersede_once(spark):
    m = memories(spark, [("a", "episodic", [], 1.0, 3, [1.0]), ("b", "semantic", [], 1.0, 3, [1.0])])
    said = [("n1", "a", 1), ("n2", "a", 2), ("n3", None, 1), ("n4", "gone", 1)]
    kind = "id string, supersedes string, h int"
    rows = spark.createDataFrame(said, kind).select("id", F.lit("u").alias("user_id"), F.lit("s").alias("session_id"), F.col("id").alias("statement"), F.lit(None).cast("string").alias("mem_type"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<string>").alias("entities"), F.array(F.lit(1.0)).alias("embedding"), "supersedes", (F.lit(NOW) + F.make_dt_interval(F.lit(0), "h")).alias("at"))
    writes = memory.recorded(rows)
    after = memory.stored_after(m, writes)
    assert values(after.select("id", F.col("valid_to").isNull(), "superseded_by").where("id <> 'x'").na.fill("-")) == [("a", False, "n1"), ("b", True, "-"), ("n1", True, "-"), ("n3", True, "-")]
    assert values(memory.refused(m, writes).select("id")) == [("n2",), ("n4",)]
    audit = memory.write_audit(m, writes)
    assert values(audit.select("memory_id", "op")) == [("a", "supersede"), ("n1", "create"), ("n3", "create")]
    assert [r["op"] for r in memory.audit_view(audit, "a").collect()] == ["supersede"]
    with pytest.raises(LookupError):
        memory.history(m, "zz")


def test_blocks_of_memories(spark):
    m = memories(spark, [("s1", "semantic", [], 0.9, 0, [1.0, 0.0]), ("s2", "semantic", [], 0.2, 0, [1.0, 0.0]), ("e1", "episodic", [], 1.0, 2, [1.0, 0.0]), ("p1", "procedural", [], 1.0, 4000, [1.0, 0.0])])
    lines = memory.block(m, "u", retrieval.vector([1, 0]), F.lit(NOW), 400)
    assert [r["line"] for r in lines.orderBy("place").collect()] == ["[semantic · conf 0.9] s1", f"[episodic · {NOW - timedelta(days=2):%Y-%m-%d}] e1", "[procedural] p1"]
    assert memory.block_text(lines).first()["text"].endswith("[procedural] p1") and tuple(memory.block_text(lines.limit(0)).first()) == ("", 0)


def test_confidences(spark):
    rows = spark.createDataFrame([("0.7",), ("1.5",), ("-1",), ("x",), (None,)], "v string")
    assert [r[0] for r in rows.select(memory.clamped(F.col("v"))).collect()] == [0.7, 1.0, 0.0, 0.5, 0.5]
    ok = spark.createDataFrame([("s", "0.5"), ("s", "1.1"), (" ", "0.9"), ("s", "x"), (None, "0.9")], "s string, c string")
    assert [r[0] for r in ok.select(memory.admissible(F.col("s"), F.col("c"))).collect()] == [True, False, False, False, False]


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, content string, content_sha string")


def test_delta(spark):
    stored = chunks(spark, ("same", "a", "1"), ("changed", "a", "1"), ("gone", "a", "1"))
    new = chunks(spark, ("same", "a", "1"), ("changed", "b", "2"), ("new", "c", "3"), ("new", "c", "3"))
    want = [("changed", "update"), ("gone", "delete"), ("new", "insert"), ("same", "skip")]
    assert values(sync.delta(new, stored)) == want
    assert values(sync.delta(new, stored, prune=False)) == [x for x in want if x[1] != "delete"]
    assert values(sync.delta(chunks(spark).limit(0), stored)) == []
    with pytest.raises(Exception, match="different contents: x"):
        sync.delta(chunks(spark, ("x", "a", "1"), ("x", "b", "2")), stored).collect()


@pytest.mark.parametrize(
    ("found", "gold", "f1"), [([1, 2], [1, 2], 1.0), ([], [], 1.0), ([], [1], 0.0), ([1], [], 0.0), ([1, 9], [1, 2, 3], 0.4), ([1, 1, 9], [1, 2, 3], 0.4)]
)
def test_f1(spark, found, gold, f1):
    row = spark.createDataFrame([(found, gold)], "f array<int>, g array<int>").select(metrics.set_f1(F.col("f"), F.col("g"))).first()
    assert row[0] == pytest.approx(f1)


def test_percentiles_are_picked_not_interpolated(spark):
    row = metrics.latency_percentiles(spark.createDataFrame([(x,) for x in [10, 40, 20, 30, 30]], "ms int")).first()
    assert tuple(row) == (30, 30)


def test_gate(spark):
    base = spark.createDataFrame([("a", 0.8), ("b", 0.8), ("c", 0.8)], "metric string, base double")
    now = spark.createDataFrame([("a", 0.79), ("b", 0.7), ("c", 0.1)], "metric string, value double")
    tolerance = spark.createDataFrame([("a", 0.02), ("b", 0.02)], "metric string, tolerance double")
    assert {r[0]: r[1] for r in metrics.gate(now, base, tolerance).collect()} == {"a": False, "b": True, "c": None}


def test_memory_results_cannot_be_cited(spark):
    calls = [(1, "memory_search", False, [("pr:1", "pr")]), (1, "merged", False, [("pr:2", "pr"), ("docs:a#b", "docs")]), (1, "merged", True, [("pr:3", "pr")])]
    rows = spark.createDataFrame(calls, "turn int, tool string, is_error boolean, citations array<struct<raw:string,kind:string>>")
    assert values(turns.turn_results(rows)) == [(1, "docs:a#b", True), (1, "pr:2", False)]


def test_synthetic_tools_are_prefix_stable(spark):
    words = lambda *w: spark.createDataFrame([(x, i) for i, x in enumerate(w)], "word string, place int")
    verbs, objects = words("get", "set"), words("a", "b", "c")
    assert [r["name"] for r in metrics.synthetic_tools(verbs, objects, 4).collect()] == ["get_a", "get_b", "get_c", "set_a"]
    with pytest.raises(ValueError, match="6"):
        metrics.synthetic_tools(verbs, objects, 7)


def test_calls_that_are_wrong_are_rows(spark):
    t = tools.Tables(prs(spark), files(spark, (1, "a")), *[None] * 4, spark.createDataFrame([], "tag string, published_at timestamp_ntz"), None, {"cold": ["a"]}, None, None)
    call = lambda name, **a: [tuple(r)[:3] for r in tools.dispatched(spark, name, a, t, D(2024, 5, 1)).collect()]
    assert call("merged_prs", window="2024", area="cold") == [("merged_prs", False, None)]
    for name, a, said in [("fly", {}, "no tool"), ("stale_prs", {"threshold_days": False}, "whole number"), ("stale_prs", {}, "needs threshold_days"), ("merged_prs", {"window": "since release v1"}, "no window"), ("merged_prs", {"window": "2024", "area": "hot"}, "no area"), ("memory_write", {"statement": "x"}, "no memory")]:
        ((tool, wrong, message),) = call(name, **a)
        assert (tool, wrong) == (name, True) and said in message
    assert tools.coerced_value("stale_prs", "threshold_days", " 14 ") == 14 and tools.coerced_value("merged_prs", "area", 5) == "5" and tools.coerced_value("stale_prs", "other", "x") == "x"
    assert [r["name"] for r in tools.definitions(spark, with_memory=False).collect()] == [n for n in sorted(tools.CATALOG) if "memory" not in n]


def test_sets_and_caches(spark, tmp_path):
    (tmp_path / "areas.json").write_text('[{"name": "a", "globs": ["x/**"]}, {"name": "b", "globs": []}]')
    assert values(sets.areas(spark, f"{tmp_path}/areas.json")) == [("a", ["x/**"]), ("b", [])]
    (tmp_path / "twice.json").write_text('[{"name": "a", "globs": []}, {"name": "a", "globs": []}]')
    with pytest.raises(ValueError, match="twice"):
        sets.areas(spark, f"{tmp_path}/twice.json")
    (tmp_path / "q.json").write_text('[{"id": "q1", "class": 2, "question": "what", "as_of": "2024-01-02", "gold_tools": ["t"]}]')
    assert values(sets.questions(spark, f"{tmp_path}/q.json").select("qid", "class", "as_of", "gold_tools", "gold")) == [("q1", 2, D(2024, 1, 2), ["t"], [])]
    results = spark.createDataFrame([("q1", 1, {"f1": 0.5}, ["a"], ["a"], None), ("q2", 1, {"f1": 0.5}, ["a"], ["a"], "timed out")], "qid string, klass int, metrics map<string,double>, predicted array<string>, gold array<string>, error string")
    sets.append_cache(results, f"{tmp_path}/cache", 2)
    sets.append_cache(results.where("qid = 'q1'"), f"{tmp_path}/cache", 1)
    assert values(sets.cache(spark, f"{tmp_path}/cache", 2).select("qid")) == [("q1",)]
    with pytest.raises(ValueError, match="no baseline"):
        evals.baseline(results, results)
    assert evals.config_hash({"b": 1, "a": True}) == evals.config_hash({"a": True, "b": 1}) and len(evals.config_hash({})) == 12
