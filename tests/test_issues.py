"""Packing of texts by tokens against a plain loop, and what bodies and threads become."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from relayscope.operators import issues

WORD = re.compile(r"[^\W]+|[^\w\s]")


def size(text):
    return len(WORD.findall(text))


def packed_by_force(units, most, overlap):
    parts, held, total = [], [], 0
    for i, unit in enumerate(units):
        if held and total + size(unit) + 1 > most:
            parts.append(held)
            n = max(m for m in range(len(held) + 1) if sum(size(units[k]) for k in held[len(held) - m :]) <= overlap)
            held = held[len(held) - n :]
            total = sum(size(units[k]) for k in held)
            if total + size(unit) + 1 > most:
                held, total = [], 0
        held, total = [*held, i], total + size(unit) + 1
    return [*parts, held]


def split_by_force(text, most, overlap):
    units = []
    for part in [p for p in re.split(r"\n\s*\n", text) if p.strip()]:
        lines = [x for x in part.splitlines() if x.strip()]
        for line in [part] if size(part) <= most else lines if len(lines) > 1 else [part]:
            words = WORD.findall(line)
            units += [line] if len(words) <= most else [" ".join(words[a : a + most]) for a in range(0, len(words), max(1, most - overlap))]
    return ["\n\n".join(units[i] for i in p) for p in packed_by_force(units, most, overlap)] if units else [text]


@pytest.mark.parametrize(("most", "overlap"), [(20, 6), (9, 3), (50, 20), (5, 5)])
def test_texts_are_split(spark, most, overlap):
    rng = random.Random(most)
    word = lambda: rng.choice(["ab", "c.d", "é", "x"])
    line = lambda: " ".join(word() for _ in range(rng.choice([1, 3, 6, 12, 30]))) + rng.choice(["\n", "\n\n", "\n \n", "\n\n\n", " "])
    texts = ["".join(line() for _ in range(rng.randrange(14))) for _ in range(150)] + ["", "  ", "\n\n"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", issues.split_text(F.col("t"), F.lit(most), overlap).alias("parts")).collect()
    assert [r for r in got if r["parts"] != split_by_force(texts[r["i"]], most, overlap)] == []


def test_bodies_and_threads(spark):
    about = spark.createDataFrame([(1, "Title", "  ", ["b", "a"]), (2, "Other", None, []), (3, "Long", "word " * 200, [])], "issue long, title string, body string, labels array<string>")
    bodies = {r["id"]: r for r in issues.body_chunks(about, most=100, overlap=10, least=20).collect()}
    assert bodies["issue:1#body"]["content"] == "# Title\nlabels: a, b" and bodies["issue:2#body"]["content"] == "# Other"
    assert sorted(i for i in bodies if i.startswith("issue:3")) == ["issue:3#body", "issue:3#body-1", "issue:3#body-2"] and bodies["issue:3#body-2"]["anchor"] == "Long (body 3)"
    said = [(1, k, a, b) for k, (a, b) in enumerate([("dependabot[bot]", "bump"), ("ann", "one"), (None, "two"), ("bob", " "), ("bob", None), ("cy", "three"), ("ann", "four"), ("ann", "five"), ("ann", "six")])] + [(9, 0, "ann", "lost")]
    threads = issues.thread_chunks(about, spark.createDataFrame(said, "issue long, at int, author string, body string"), ["at"]).collect()
    assert [(r["id"], r["anchor"], r["content"]) for r in sorted(threads, key=lambda r: r["id"])] == [
        ("issue:1#comment-0", "Title (comments 1-5)", "# Title\n\n@ann: one\n\n@unknown: two\n\n@cy: three\n\n@ann: four\n\n@ann: five"),
        ("issue:1#comment-1", "Title (comments 6-6)", "# Title\n\n@ann: six"),
    ]
