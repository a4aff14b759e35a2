"""Ids without collisions, and the stored index under deltas."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from relayscope.operators import ingest, sync


def ids_by_force(bases, mark):
    used, out = set(), []
    for base in bases:
        name, n = base, 2
        while name in used:
            name, n = f"{base}{mark}{n}", n + 1
        used.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize("mark", ["-", "#part-"])
def test_unique_ids(spark, mark):
    rng = random.Random(2)
    forms = ["a", "a", "a", "a-2", "a-3", "a-2-2", "a-02", "b", "a-4", "a-2-3", "b-7", "a-1", "a-2-2-2"]
    rows = [(g, i, rng.choice(forms).replace("-", mark)) for g in range(40) for i in range(rng.randrange(1, 30))]
    got = {(r["g"], r["i"]): r["id"] for r in ingest.unique_ids(spark.createDataFrame(rows, "g int, i int, base string").repartition(5), "base", ["i"], ["g"], mark).collect()}
    for g in range(40):
        mine = [r for r in rows if r[0] == g]
        assert [got[g, i] for _, i, _ in mine] == ids_by_force([b for _, _, b in mine], mark)


def candidates(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id string, content string").withColumn("content_sha", F.sha2("content", 256))


def embed(rows):
    return rows.withColumn("v", F.array(F.length("content").cast("double")))


def stored(spark, path):
    return {r["id"]: (r["content"], r["v"]) for r in spark.read.parquet(path).collect()}


def written_at(path):
    return {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path) if f.startswith("part=")}


def test_deltas_rewrite_only_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = {f"c{i}": f"text {i}" for i in range(200)}
    sync.applied(path, candidates(spark, texts), embed, parts=16)
    assert stored(spark, path) == {i: (t, [float(len(t))]) for i, t in texts.items()}
    before = written_at(path)
    texts["c3"], texts["new"] = "another text", "one more"
    del texts["c8"]
    counts = sync.applied(path, candidates(spark, texts), embed, parts=16).collect()
    assert sum(r["inserted"] for r in counts) == sum(r["updated"] for r in counts) == sum(r["deleted"] for r in counts) == 1
    assert stored(spark, path) == {i: (t, [float(len(t))]) for i, t in texts.items()}
    after = written_at(path)
    assert {f for f in after if after[f] != before.get(f)} == {f"part={r['part']}" for r in counts} and len(counts) <= 3
    assert sync.applied(path, candidates(spark, texts), embed, parts=16).count() == 0 and written_at(path) == after


def test_emptied_parts_go_and_no_candidates_change_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    sync.applied(path, candidates(spark, {"a": "1", "b": "2", "c": "3"}), embed, parts=64)
    assert sync.applied(path, candidates(spark, {}), embed, parts=64).count() == 0 and set(stored(spark, path)) == {"a", "b", "c"}
    sync.applied(path, candidates(spark, {"b": "2"}), embed, parts=64)
    assert set(stored(spark, path)) == {"b"}
    assert sync.applied(path, candidates(spark, {"d": "4"}), embed, parts=64, prune=False).count() == 1 and set(stored(spark, path)) == {"b", "d"}
