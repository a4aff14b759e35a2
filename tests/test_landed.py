"""Landed responses: what is used, what is kept aside, and what a replay changes."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from relayscope.sources import landed


@pytest.fixture
def folder(tmp_path):
    def page(kind, items, ref=None):
        return json.dumps({"kind": kind, "ref": ref, "page": items})

    issue = {"number": 1, "title": "old", "updated_at": "2024-01-01T00:00:00Z", "user": None}
    lines = [
        page("issue", [issue, issue | {"title": "new", "updated_at": "2024-02-01T00:00:00Z"}, {"title": "lost"}, {"number": 2, "updated_at": "soon"}]),
        "{ broken", "", "[1]", page("wiki", []), page("wiki", [{}]), json.dumps({"kind": "issue"}), json.dumps({"page": []}),
        page("comment", [{"id": 5, "body": "hi", "user": {"login": "ann"}, "created_at": "2024-01-03T00:00:00Z"}], "1"), page("comment", [{"id": 5, "body": "hi", "user": {"login": "ann"}, "created_at": "2024-01-03T00:00:00Z"}], "2"),
        page("commit", [{"sha": "abc", "commit": {"committer": {"date": "2024-03-01T00:00:00Z"}}}], "main"),
        page("release", [{"tag_name": "v1", "name": "", "published_at": None, "created_at": "2024-01-01T00:00:00Z"}]),
    ]
    for name in ("a", "b"):  # everything lands twice
        (tmp_path / name).mkdir()
        (tmp_path / name / "page.json").write_text("\n".join(lines))
    return str(tmp_path)


def test_payloads_are_used_or_kept(spark, folder, tmp_path_factory):
    aside = str(tmp_path_factory.mktemp("q") / "aside")
    rows, seen = landed.ingested(spark, folder, aside)
    got = {(r["kind"], r["reason"]): r["n"] for r in landed.counts(rows).collect()}
    assert got == {
        ("issue", None): 2, ("issue", "no number"): 1, ("issue", "no updated_at"): 1, (None, "no JSON"): 2, ("wiki", "unknown kind"): 2, ("issue", "no page"): 1, (None, "no kind"): 1,
        ("comment", None): 2, ("commit", None): 1, ("release", None): 1,
    }
    assert seen["payloads"] == 28 and seen["used"] == 12 and seen["left"] == 16
    assert spark.read.parquet(aside).count() == 16


def test_records(spark, folder):
    rows = landed.payloads(spark, folder)
    assert [(r["number"], r["title"]) for r in landed.records(rows, "issue").collect()] == [(1, "new")]
    assert sorted(map(tuple, landed.issue_comments(rows).collect())) == [(n, 5, "ann", "hi", datetime(2024, 1, 3)) for n in (1, 2)]
    assert [tuple(r) for r in landed.releases(rows).collect()] == [("v1", "", datetime(2024, 1, 1), None)]
    assert [tuple(r) for r in landed.pinned(rows, "main").collect()] == [("abc", datetime(2024, 3, 1))]
    with pytest.raises(LookupError):
        landed.pinned(rows, "dev")


def test_tables_of_two_runs(spark, tmp_path):
    def run(name, items):
        (tmp_path / name).mkdir()
        (tmp_path / name / "page.json").write_text("\n".join(json.dumps({"kind": k, "ref": None, "page": p}) for k, p in items))
        return landed.tables(landed.payloads(spark, str(tmp_path / name)))

    issue = lambda n, labels, **more: {"number": n, "title": "t", "state": "open", "updated_at": "2024-01-01T00:00:00Z", "labels": [{"name": x} for x in labels]} | more
    commit = lambda sha, files: {"sha": sha, "author": None, "commit": {"message": "m (#7)", "author": {"name": "Ann", "date": "2024-01-02T00:00:00Z"}}, "files": [{"filename": f} for f in files]}
    first = run("a", [("issue", [issue(1, ["x", "x", "y"]), issue(2, ["z"]), issue(3, ["p"], pull_request={"url": "u"})]), ("commit", [commit("s1", ["f", "g", "f"])])])
    second = run("b", [("issue", [issue(1, [])]), ("commit", [commit("s2", ["h"])]), ("pull", [{"number": 7, "title": "p", "state": "closed", "updated_at": "2024-01-03T00:00:00Z", "merged_at": "2024-01-03T00:00:00Z"}])])
    every = landed.stored_after(first, second)
    found = {name: sorted(map(tuple, every[name].select(*columns).collect())) for name, columns in {"issues": ["number"], "issue_labels": ["issue_number", "label"], "commits": ["sha", "author"], "commit_files": ["sha", "path"], "pull_requests": ["number", "state", "author"]}.items()}
    assert found == {"issues": [(1,), (2,)], "issue_labels": [(2, "z")], "commits": [("s1", "Ann"), ("s2", "Ann")], "commit_files": [("s1", "f"), ("s1", "g"), ("s2", "h")], "pull_requests": [(7, "merged", "ghost")]}


def test_baselines_are_written_or_refused(spark, tmp_path):
    from relayscope.operators import evals

    results = spark.createDataFrame([("q1", None), ("q2", None)], "qid string, error string")
    current = spark.createDataFrame([("recall", 0.5)], "metric string, value double")
    for _ in range(2):
        evals.write_baseline(current, results, str(tmp_path / "b"), {"k": 5})
    (row,) = spark.read.json(str(tmp_path / "b")).collect()
    assert (row["metric"], row["value"], row["config"]) == ("recall", 0.5, evals.config_hash({"k": 5}))
    with pytest.raises(ValueError, match="no baseline"):
        evals.write_baseline(current, results.limit(1), str(tmp_path / "c"), {})
