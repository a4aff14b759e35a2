from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from relayscope.llm.shared import written

rng = random.Random(9)


def prose(n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def test_each_stage_decides_on_its_predecessors_rows(spark, tmp_path):
    clean = [(i, prose(60)) for i in range(300)]
    toxic = [(1000 + i, prose(30) + " toadface " + prose(30)) for i in range(60)]
    copies = [(2000 + i, clean[i][1]) for i in range(20)]
    near = [(3000 + i, clean[i + 50][1] + " tail") for i in range(20)]
    odd = [(4000, None), (4001, ""), (None, prose(20))]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in clean + toxic + copies + near + odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]

    seen = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns
        seen[name], docs = [r["doc_id"] for r in out.select("doc_id").collect()], out
    ids = lambda rows: {i for i, _ in rows}
    gone = ids(toxic) - set(seen["toxicity"])
    assert len(gone) >= 50 and not (ids(clean) | ids(odd)) - set(seen["toxicity"])
    # Of copies the largest doc_id stays, of the two empty texts too.
    assert set(seen["exact_dedup"]) == set(seen["toxicity"]) - set(range(20)) - {4000}
    assert set(seen["near_dedup"]) == set(seen["exact_dedup"]) - ids(near)
    assert set(seen["mixing"]) == set(seen["near_dedup"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(seen["mixing"])
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.where("n > 2048").isEmpty()


def test_rows_that_share_a_doc_id_or_have_none_are_decided_apart(spark, tmp_path):
    clean, base = [(i, prose(40)) for i in range(300)], prose(60)
    toxic = [(1000 + i, prose(20) + " toadface " + prose(20)) for i in range(60)]
    rude, fine, shared = prose(15) + " toadface " + prose(15), [prose(40) for _ in range(4)], prose(40)
    odd = [(None, rude), (None, fine[0]), (2000, rude), (2000, fine[1])]  # toxic and clean
    odd += [(None, shared), (3000, shared), (3001, fine[2]), (3001, fine[2]), (None, fine[3]), (None, fine[3])]  # copies
    odd += [(4000, base), (None, base + " tail"), (4001, base + " end"), (4001, prose(30))]  # near copies
    rows = [(i, t, "en", "src0", len(t)) for i, t in clean + toxic + odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, mine = [], set(odd)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        seen.append(sorted((x for x in rows if x in mine), key=str))
    left = lambda gone: sorted((x for x in odd if x not in gone), key=str)
    assert seen[0] == left([(None, rude), (2000, rude)])
    once = [x for x in left([(None, rude), (2000, rude), (None, shared)]) if x[1] not in fine[2:]] + [(3001, fine[2]), (None, fine[3])]
    assert seen[1] == sorted(once, key=str)
    # Null is the smallest doc_id: its near copies go, the other text of 4001 stays.
    assert seen[2] == sorted((x for x in once if x[1] not in (base, base + " end")), key=str)


NAMES = ("pipeline_id", "pipeline_digest", "pipeline_key", "pipeline_rest", "pipeline_text_sha256", "text_sha256", "doc", "text_key", "mix_text", "mix_tokens", "mix_rate", "mix_copies", "copies", "score", "kept", "row", "a.b")


def test_columns_that_clash_and_tables_without_rows(spark, tmp_path):
    rows = [(i, prose(30), *(f"{c}{i}" for c in NAMES)) for i in range(40)]
    rows += [(100, rows[3][1], *NAMES), (None, None, *NAMES)]
    schema = ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in NAMES)])
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given, left in ((rows, 41), ([], 0)):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == ["doc_id", "text", *NAMES]
        assert docs.dropDuplicates(["doc_id"]).count() == left
        assert all(r["a.b"] == f"a.b{r['doc_id']}" and r["doc"] == f"doc{r['doc_id']}" for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 100)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == left
    plain = spark.createDataFrame([(1, "only these"), (2, "only these")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, plain, str(tmp_path)).collect()] == [2]
