"""Runs, token counts and the manifest against brute force, and on rows that are odd."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from relayscope.llm import lines, merkle, queries, runs, token_counts

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, place long, digest string, tree string, n long, path string, words string"
rng = random.Random(11)


def frame(spark, rows):
    """``rows`` of doc_id, text, source; other columns clash with names that the operators use."""
    return spark.createDataFrame([(i, t, "en" if i else None, s, 3, 7, "d", "t", 9, "p", "w") for i, t, s in rows], DOCUMENTS).repartition(3)


ODD = [
    (0, None, "a"),
    (1, "", "a"),
    (2, " \t\x0b\n", "b"),
    (3, "one", None),
    (4, "  one  two \n", "a"),
    (5, "x | " * 4000, "a"),
    (6, "a" * 5000, "é"),
    (7, " " * 3000 + "b" + " " * 15 + "😀", "b"),
    (8, "Ab Cd ÄÖ " * 30, "a"),
    (8, "another text of a doc_id", "a"),
    (9, "same row " * 9, "a"),
    (9, "same row " * 9, "a"),
    (None, "no id, no id, no id", "a"),
    (None, "ba co di fu " * 3 + "end", None),
]


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# -- runs ---------------------------------------------------------------------


def runs_by_force(words, shortest):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(shortest, 2 * q) and j > i and not any(stretch[k:] == stretch[:-k] for k in range(1, q)):
                found.append((i, len(stretch), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def described_by_force(doc_id, text, shortest):
    words = (text or "").encode().split()
    found = runs_by_force(words, shortest)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    longest = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    shown = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    left = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(found), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), hashlib.sha256(left).hexdigest())


def periodic(k):
    words = [rng.choice("abcdefgh"[:k]) for _ in range(rng.randrange(60))]
    kind = rng.randrange(4)
    if kind == 1:
        words = (words[: rng.randrange(1, 9)] * 30)[: rng.randrange(60)]
    elif kind == 2:
        words = words[:9] + words[3:9] * rng.randrange(5) + words[:20] + words[2:7] * 4
    return " ".join(words)


@pytest.mark.parametrize("shortest", [12, 5])
def test_runs_of_generated_texts(spark, shortest):
    rows = [(i, periodic(rng.choice([1, 2, 3, 6])), "s") for i in range(400)]
    got = sorted(map(tuple, runs.periodic_runs(frame(spark, rows), shortest).collect()))
    assert got == sorted(described_by_force(i, t, shortest) for i, t, _ in rows)


def test_runs_of_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 5]
    got = sorted(map(tuple, runs.periodic_runs(frame(spark, rows)).collect()), key=str)
    assert got == sorted((described_by_force(i, t, 12) for i, t, _ in rows), key=str)
    (long,) = runs.periodic_runs(frame(spark, [(5, "x | " * 4000, "a")])).collect()
    assert tuple(long)[1:6] == (1, 0, 8000, 2, 4000000)
    assert runs.periodic_runs(frame(spark, [])).count() == 0


def test_a_run_of_many_words_with_many_runs_inside(spark):
    a, b = "a", "a b"
    while len(b) < 3000:
        a, b = b, f"{b} {a}"
    (got,) = runs.periodic_runs(frame(spark, [(1, b, "s")])).collect()
    assert tuple(got) == described_by_force(1, b, 12)


def planted_by_force(doc_id, text):
    h, words = zlib.crc32(str(doc_id).encode()), (text or "").encode().split()
    if doc_id is None or h % 10 or not words:
        return text
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n)).decode()


def test_planted_runs(spark):
    rows = [(i, " ".join(rng.choice("abcdé") * 2 for _ in range(rng.randrange(30))), "s") for i in range(300)] + [(300 + i, t, s) for i, (_, t, s) in enumerate(ODD)] + [(None, "a b", "s")]
    got = sorted(map(tuple, runs.with_planted_runs(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, planted_by_force(i, t)) for i, t, _ in rows), key=str)


# -- token counts -------------------------------------------------------------

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def library_counts(rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = []
    for i, t, _ in rows:
        n = len(library.encode(t or ""))
        out.append((i, len((t or "").encode()), n, n > 100))
    return sorted(out, key=str)


def generated_texts():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    alphabets = [
        [chr(c) for c in range(32, 127)] + list("  ▁éßñ中日本한\n\t\x00　​🙂"),
        [chr(c) for c in (*range(32, 592), *range(0x400, 0x460), *range(0x4E00, 0x4E60), *range(0x1F600, 0x1F640))] + [" "] * 90,
        list("aeintsor"),
        ["in", "the", "=", "==", "-", "--", "0", "00", " ", "  ", "\\"],
        pieces,
    ]
    return ["".join(rng.choice(a) for _ in range(rng.randrange(70))) for a in alphabets for _ in range(1200)]


def test_token_counts_of_generated_texts(spark):
    rows = [(i, t, "s") for i, t in enumerate(generated_texts())]
    assert sorted(map(tuple, token_counts.token_counts(frame(spark, rows), limit=100).collect()), key=str) == library_counts(rows)


def test_token_counts_of_odd_rows(spark):
    rows = [*ODD, (20, "<s>a</s><unk> <0x0A> [INST]", "s"), (21, " " * 33, "s"), (22, "=" * 999, "s")]
    assert sorted(map(tuple, token_counts.token_counts(frame(spark, rows), limit=100).collect()), key=str) == library_counts(rows)
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def test_a_batch_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 50)
    import pyarrow as pa

    texts = generated_texts()[:200]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts, pa.string())], names=["doc_id", "text"])
    (out,) = token_counts.counter(PIECES, 100)(iter([batch]))
    assert [(r["doc_id"], r["n_tokens"]) for r in out.to_pylist()] == [(i, n) for i, _, n, _ in sorted(library_counts([(i, t, "") for i, t in enumerate(texts)]), key=lambda r: r[0])]


# -- manifest -----------------------------------------------------------------


def tree_by_force(digests, fan_out):
    ways, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, k in enumerate(at):
            first = k // fan_out * fan_out
            ways[i].append(("".join(level[first:k]), "".join(level[k + 1 : first + fan_out])))
        at = [k // fan_out for k in at]
        level = [sha(*level[k : k + fan_out]) for k in range(0, len(level), fan_out)]
    return level[0], ways


def manifest_by_force(rows, fan_out):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, s: sha(*map(shown, (i, s, "en" if i else None, 3, t)))
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = defaultdict(list)
    for i, t, s in rows:
        groups[s].append((i is not None, i or 0, leaf(i, t, s), i, t))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_by_force([r[2] for r in sorted(groups[s])], fan_out) for s in order}
    root, upper = tree_by_force([trees[s][0] for s in order], fan_out)
    out = []
    for s, over in zip(order, upper, strict=True):
        for (_, _, own, i, t), way in zip(sorted(groups[s]), trees[s][1], strict=True):
            way = way + over
            folded = leaf(i, lower(t), s) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else own
            for before, after in way:
                folded = sha(before, folded, after)
            out.append((i, own, trees[s][0], root, sha(*(b + a for b, a in way)), folded, folded == root))
    return sorted(out, key=str)


def manifest(spark, rows, fan_out=16):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return sorted(map(tuple, merkle.manifest(frame(spark, rows), tampered, merkle.lowered(F.col("text")), fan_out).collect()), key=str)


@pytest.mark.parametrize("fan_out", [16, 2])
def test_manifest(spark, fan_out):
    sources = ["hot"] * 90 + ["b", "é", "z", None, "", "c"] * 6 + ["lone"]
    rows = [(i, f"Text {i % 40} ÄB", s) for i, s in enumerate(sources)]
    got = manifest(spark, rows, fan_out)
    assert got == manifest_by_force(rows, fan_out)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2


def test_manifest_of_odd_rows(spark):
    assert manifest(spark, ODD) == manifest_by_force(ODD, 16)
    assert manifest(spark, ODD[:2]) == manifest_by_force(ODD[:2], 16)  # one source
    assert manifest(spark, ODD[3:4]) == manifest_by_force(ODD[3:4], 16)  # one leaf
    assert manifest(spark, ODD[2:5]) == manifest_by_force(ODD[2:5], 16)  # lone leaves only
    assert manifest(spark, []) == []


def test_queries_are_registered():
    assert {"op11_periodic_runs", "op12_token_counts", "op13_merkle_manifest"} <= set(queries.queries())


def test_lines_have_few_keys(spark):
    """About twelve keys a line, computed and moved twice, took 465 CPU seconds a GB."""
    rows = [(n, "".join(rng.choice("abcdefgh é") for _ in range(n)), n) for n in range(1, 120)]
    frame = spark.createDataFrame(rows, "id long, line string, n int")
    probes = dict(lines.keys(frame, 2, False).groupBy("id").count().collect())
    own = dict(lines.keys(frame, 2, True).groupBy("id").count().collect())
    assert own == {n: 2 if n < 20 else 3 for n in range(10, 120)}
    assert max(probes.values()) <= 8 and sum(probes[n] for n in range(22, 118)) <= 5.5 * 96


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_line_links_at_the_borders_of_classes(spark, edits):
    pool = set()
    for n in [*range(8, 15), *range(18, 34), 38, 39, 40, 41]:
        seed = [rng.choice("abcdeé ") for _ in range(n)]
        for _ in range(24):
            s = list(seed)
            for _ in range(rng.choice([0, 1, 2, 2, 3])):
                k = rng.choice([0, len(s) - 1, rng.randrange(len(s))])
                s[k : k + rng.choice([0, 1])] = rng.choice(["", "x", s[k]])
            # One character goes in near the beginning and another goes out near the end, or the other way round.
            for one, other in ((rng.randrange(n // 3 + 1), -1 - rng.randrange(n // 3)), (-1 - rng.randrange(n // 3), rng.randrange(n // 3 + 1))):
                t = list(seed)
                t.insert(one, "y")
                del t[other]
                pool.add("".join(t))
            pool.add("".join(s))
    rows = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(sorted(pool))], "id long, line string, n int")
    got = [tuple(r) for r in lines.line_links(rows, edits).collect()]
    pairs = rows.alias("x").join(rows.alias("y"), (F.col("x.id") < F.col("y.id")) & (F.abs(F.col("x.n") - F.col("y.n")) <= edits))
    pairs = pairs.where(F.expr(f"levenshtein(x.line, y.line) <= least({edits}, least(x.n, y.n) div 10)"))
    assert sorted(got) == sorted(tuple(r) for r in pairs.select("x.id", "y.id").collect()) and bool(got) == (edits > 0)


def test_common_ends_of_lines_are_left_out(spark):
    base = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    rows = [(base, base[:1500] + "x" + base[1502:]), (base, base[1:]), (base, base[:-2]), (base, base + "é"), ("ab" * 400, "ab" * 401), ("a" * 10, "a" * 12), ("abc", "abd"), ("é" * 40, "é" * 20 + "x" + "é" * 20)]
    got = spark.createDataFrame(rows, "a string, b string").withColumn("t", lines.without_common_ends(F.col("a"), F.col("b"), 2))
    got = got.select("*", F.levenshtein("a", "b").alias("whole"), F.levenshtein("t.a", "t.b").alias("rest"), lines.banded_distance(F.col("t.a"), F.col("t.b"), 2).alias("banded"), F.length("t.a").alias("n"), F.length("t.b").alias("m")).collect()
    assert all(r["whole"] == r["rest"] == r["banded"] and min(r["n"], r["m"]) > 2 for r in got) and max(r["n"] for r in got) < 30
