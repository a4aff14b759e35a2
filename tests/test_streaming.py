import json

from relayscope.streaming import ingest


def test_later_versions_replace_and_replays_change_nothing(spark, tmp_path):
    landing, out = tmp_path / "landing", tmp_path / "out"
    landing.mkdir()
    (landing / "1.json").write_text("\n".join(json.dumps(r) for r in [{"number": 1, "v": 2, "title": "new"}, {"number": 1, "v": 1, "title": "old"}, {"number": 2, "v": 1, "title": "b"}]) + "\nnot json\n")
    state = {"n": -1}
    empty = spark.createDataFrame([], "number long, v long, title string")
    read = lambda: spark.read.parquet(f"{out}/{state['n']}") if state["n"] >= 0 else empty

    def write(rows, number):
        rows.write.mode("overwrite").parquet(f"{out}/{number}")
        state["n"] = number

    run = lambda: ingest.upserts(ingest.landed(spark, str(landing), "number long, v long, title string"), ["number"], "v", read, write, str(tmp_path / "c"), str(tmp_path / "q")).awaitTermination()
    run()
    assert sorted(map(tuple, read().collect())) == [(1, 2, "new"), (2, 1, "b")]
    (landing / "2.json").write_text(json.dumps({"number": 2, "v": 3, "title": "c"}) + "\n" + json.dumps({"number": 1, "v": 1, "title": "stale"}) + "\n")
    run()
    assert sorted(map(tuple, read().collect())) == [(1, 2, "new"), (2, 3, "c")]
    run()
    assert sorted(map(tuple, read().collect())) == [(1, 2, "new"), (2, 3, "c")]
    kept = [tuple(r) for r in spark.read.parquet(str(tmp_path / "q")).select("text", "reason").collect()]
    assert kept == [("not json", "no JSON")]
