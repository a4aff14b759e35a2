"""The ten operators against brute force, and on rows that are odd."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relayscope.llm import chat, components, exact_dedup, lines, minhash, mixing, packing, pii, substrings, topk, toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, id long, place string, n int, fingerprint string, label int"
rng = random.Random(5)
WORDS = ["ba", "co", "di", "fu", "élan", "Go", "hu", "in", "jo", "ka", "lu", "mo"]


def prose(n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


LONG = prose(30_000)
BASE = prose(120)
ODD = [
    (0, None),
    (1, ""),
    (2, " \t\n"),
    (3, "one"),
    (4, "one two"),
    (5, "ONE TWO"),
    (6, BASE),
    (7, BASE.replace("ba", "xx", 1)),
    (8, BASE),
    (9, LONG),
    (10, "a" * 700),
    (11, prose(60) + " " + BASE),
    (11, "a row that repeats a doc_id"),
    (12, "same row"),
    (12, "same row"),
    (None, BASE),
    (13, "x | " * 100),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", 3, 77, "p", 1, "f", 1) for i, t in rows], DOCUMENTS).repartition(3)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_by_force(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates(spark):
    rows = [(i, prose(rng.choice([1, 2, 3, 8, 40]))) for i in range(40)]
    bases = [prose(70) for _ in range(3)]
    for i in range(40, 110):
        words = rng.choice(bases).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    for n, percent in ((3, 85), (5, 80)):
        assert by_id(minhash.near_duplicates(frame(spark, rows), n, percent), "n_shingles", "component_id") == near_by_force(rows, n, percent)


def test_near_duplicates_of_several_texts_of_one_doc_id(spark):
    one, two = prose(60), prose(60)
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " x"), (5, "alone " + prose(9)), (5, "alone " + prose(8))]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 5, True), (5, 5, True)]
    rows = [(None, one), (1, one + " x"), (None, two), (None, two + " x"), (4, two + " x"), (4, prose(30))]
    left = sorted((r["doc"], r["text_key"]) for r in minhash.rows_to_drop(frame(spark, rows), 3, 85).collect())
    assert len(left) == 3 and {i for i, _ in left} == {1, 4, -(2**63)}


def test_near_duplicates_within_a_chained_family(spark):
    """A bucket of many sets of which few are links of the smallest one."""
    words = prose(80).split()
    rows = []
    for i in range(60):
        at = rng.randrange(len(words) - 6)
        words = words[:at] + [rng.choice(WORDS) for _ in range(rng.choice([1, 2]))] + words[at + rng.choice([0, 1, 2]) :]
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    assert by_id(minhash.near_duplicates(frame(spark, rows), 3, 85), "n_shingles", "component_id") == near_by_force(rows, 3, 85)


def test_near_duplicates_of_odd_rows(odd, none):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd, 3, 85).collect())
    assert len(got) == len(ODD)
    by = {(r[1], r[2]): r[3:] for r in got if not r[0]}
    assert by[0, 0] == (0, True) and by[2, 0] == (2, True) and by[4, 1] == (4, True) and by[5, 1] == (4, False)
    assert by[6, 118] == (6, True) and by[8, 118] == (6, False) and by[12, 1] == (12, True)
    assert got[-1] == (True, 0, 118, None, True)
    assert minhash.near_duplicates(none).collect() == []


def test_signatures_estimate_similarity():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(7919)
    b = a + np.uint64(250 * 7919)
    both = np.concatenate((a, b))
    s = minhash.signatures(both, np.array([1000, 1000]), 512)
    assert abs((s[0] == s[1]).mean() - 750 / 1250) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 99), (99, 98), (7, 7), (100, 99)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 98: 98, 99: 98, 100: 98}


def test_exact_duplicates(odd, none):
    rows = exact_dedup.exact_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in rows}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    groups: dict[str, list] = {}
    for i, t in ODD:
        groups.setdefault(t or "", []).append(i)
    for i, t in ODD:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        assert got[i, sha(t)] == (keep, len(same), i == keep)
    assert exact_dedup.exact_duplicates(none).collect() == []


def test_filters_merge_without_loss():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000, dtype=np.uint64))
    counts = np.arange(len(keys)) % 5 + 1
    k, c = exact_dedup.unpacked(*exact_dedup.packed(keys, counts))
    assert (k == keys).all() and (c == counts).all()
    k, c = exact_dedup.summed(np.r_[keys, keys[:7]], np.r_[counts, counts[:7]])
    assert (k == keys).all() and (c[:7] == 2 * counts[:7]).all()


def removed_by_force(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_repeated_substrings(spark, none, monkeypatch):
    rows = {i: t for i, t in ODD if i not in (None, 12)} | {11: prose(60) + " " + BASE, 20: LONG[5000:90_000] + "é", 21: "ab" * 90 + BASE[:150] + "ab" * 90}
    rows |= {30 + i: BASE[: 99 + i] + prose(3) for i in range(4)}
    want = removed_by_force(list(rows.items()))
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = substrings.repeated_substrings(frame(spark, list(rows.items())))
    assert by_id(got, *columns) == want
    text = BASE.encode()
    assert [(s["start"], s["stop"]) for s in got.where("doc_id = 8").first()["spans"]] == [(0, len(text))]
    assert substrings.repeated_substrings(none).collect() == []


def test_repeated_substrings_of_rows_that_share_a_doc_id(spark):
    """Rows with a doc_id in common, or without one, lose only what another document has before them."""
    here = random.Random(17)
    made = lambda n: " ".join("".join(here.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    same, twice, shared, own, nulls = made(40), made(30), made(40), [made(50) for _ in range(3)], [made(60) for _ in range(3)]
    inner = twice + "|" + twice
    rows = [(12, same), (12, same), (13, inner), (13, inner), (None, nulls[0]), (None, nulls[0]), (None, nulls[1] + nulls[0]), (None, nulls[2]), (-(2**63), nulls[2])]
    rows += [(14, own[0] + shared), (14, own[1] + shared), (14, "short"), (15, own[2]), (15, own[2] + made(200) + own[2])]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in substrings.repeated_substrings(frame(spark, rows)).collect()]
    lost = lambda i, t: sorted(x for a, b, x in got if a == i and b == len(t))
    assert sorted((i is not None, i or 0, b) for i, b, _ in got) == sorted((i is not None, i or 0, len(t)) for i, t in rows)
    assert lost(12, same) == [0, 0] and lost(13, inner) == [len(twice)] * 2 and lost(14, "short") == [0]
    # A clean row without doc_id stays whole; of equal texts the null comes before the lowest doc_id.
    assert [x for i, t, x in got if i is None and t == len(nulls[2])].count(0) >= 1 and lost(-(2**63), nulls[2]) == [len(nulls[2])]
    # Of two texts of one doc_id with a passage in common, one loses it and the other nothing.
    assert lost(14, own[0] + shared) == [0, len(shared)]
    assert sum(x for i, _, x in got if i is None) in (2 * len(nulls[0]), len(nulls[0]))
    assert sum(x for i, _, x in got if i == 15) == 2 * len(own[2])


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 1000)
    import pyarrow as pa

    texts = [prose(900), "", prose(3)]
    seen: dict[int, bytearray] = {}
    for data, rows, starts, before in substrings.blocks(pa.array(texts)):
        for k, row in enumerate(rows):
            seen.setdefault(int(row), bytearray(len(texts[row].encode())))[before[k] : before[k] + starts[k + 1] - starts[k]] = bytes(data[starts[k] : starts[k + 1]])
    assert [bytes(seen[i]).decode() for i in range(3)] == texts


def test_packing(odd, none):
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in ODD]
    rows = packing.packed(odd).collect()
    want = Counter()
    for (i, _), x in zip(ODD, ids, strict=True):
        cuts = packing.cut(len(x), 2048)
        assert len(cuts) == -(-len(x) // 2048) and all(b - a == 2048 for a, b in cuts[1:])
        want.update((i, k, a, b - a, zlib.crc32(x[a:b])) for k, (a, b) in enumerate(cuts))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(map(len, ids)) // 2048)
    assert packing.packed(none).collect() == []


def test_packing_of_texts_that_spell_an_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"{end} hi", f"hi  {end}  there", f"a{end}{end}b \n{end}", end, f"<|endoftext|{end}|>", f"É{end}é\t {end} "]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert tokenizer.token_to_id(end) in ids
        want[i] = (0, len(ids), zlib.crc32(ids))
    assert by_id(packing.packed(frame(spark, list(enumerate(texts)))), "start", "length", "ids_crc32") == want


def test_two_pieces_replace_the_shortest():
    # Greedy takes 6 and then 3; 2 + 2 fill the sequence of 10 that 6 + 3 leaves open.
    kinds = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(kinds[0][0]) == [2, 2, 6]


def test_toxicity(spark, none):
    insults, clean = ["grubworm", "toadface"], [prose(rng.choice([5, 40, 200])) for _ in range(900)]
    rows, labels = [], []
    for i, text in enumerate(clean):
        bad = i % 6 == 0
        words = text.split()
        if bad:
            words.insert(rng.randrange(len(words) + 1), rng.choice(insults) + "!!")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "you toadface"), (5002, LONG + " grubworm"), (5003, LONG)]
    table = spark.createDataFrame([*labels, (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(frame(spark, rows), table).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(by[i]["predicted"], toxic) for i, _, toxic in labels if by[i]["held_out"]]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert [by[i]["predicted"] for i in (5000, 5001, None, 5002, 5003)] == [0, 0, 1, 1, 0]
    assert toxicity.toxicity_scores(none, table).collect() == []
    assert {r["score"] for r in toxicity.toxicity_scores(frame(spark, rows[:5]), table.limit(0)).collect()} == {0.0}


def test_ftrl_follows_the_published_recurrences():
    """Against plain Python, a coordinate at a time."""
    import math

    how = toxicity.Settings(alpha=0.7, beta=0.5, l1=0.3, l2=0.2, epochs=2)
    here = random.Random(3)
    rows = [sorted(here.sample(range(12), here.choice([0, 1, 3, 6]))) for _ in range(40)]
    labels = [float(0 in r or 5 in r) for r in rows]
    z, n, bias, bias_n = [0.0] * 12, [0.0] * 12, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= how.l1:
            return 0.0
        return -(z[i] - math.copysign(how.l1, z[i])) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for r, y in zip(rows, labels, strict=True):
            w = [weight(i) for i in r]
            g = 1 / (1 + math.exp(-(sum(w) + bias))) - y
            for i, wi in zip(r, w, strict=True):
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha
                z[i] += g - sigma * wi
                n[i] += g * g
            bias_n += g * g
            bias -= how.alpha / (how.beta + math.sqrt(bias_n)) * g
    w, b = toxicity.trained([np.array(r, np.int32) for r in rows], np.array(labels), how)
    assert np.allclose(w[:12], [weight(i) for i in range(12)]) and np.isclose(b, bias) and not w[12:].any() and (w[:12] == 0).any()


def test_one_model_learns_from_all_sampled_rows(spark):
    """The result doesn't depend on how the rows are dealt out."""
    rows = [(i, prose(12) + (" toadface" if i % 4 == 0 else "")) for i in range(200)]
    table = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    one, two = (by_id(toxicity.toxicity_scores(frame(spark, rows).repartition(k), table), "score") for k in (1, 7))
    assert one == two


SAID = r"\### Assistant: </turn> ok"


def test_chats_round_trip(spark):
    rows = [(1, 0, "user", SAID), (1, 1, "assistant", SAID), (1, 2, "assistant", None), (1, 3, "<turn:", "<text>\\1\\0é😀"), (2, 0, None, "x"), (None, 0, "assistant", "y"), (2, 0, None, "x")]
    chats = chat.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    read = {r["conv_id"]: r for r in chats.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned"), "formatted").collect()}
    assert [tuple(t) for t in read[1]["turns"]] == [("user", SAID), ("assistant", SAID), ("assistant", ""), ("<turn:", "<text>\\1\\0é😀")]
    assert read[1]["learned"] == SAID and [tuple(t) for t in read[2]["turns"]] == [("", "x"), ("", "x")] and read[None]["learned"] == "y"
    digest = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    assert digest[1]["loss_chars"] == len(SAID) and digest[1]["formatted_chars"] == len(read[1]["formatted"])
    assert chat.digests(chat.rendered(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_events_fold(spark):
    events = [
        (1, 1, 0, "message", "user", "hi"),
        (1, 2, 1, "message", "assistant", ""),
        (1, 3, 1, "delta", None, "he"),
        (1, 4, 1, "delta", None, "llo"),
        (1, 5, 2, "message", "user", "old"),
        (1, 6, 0, "edit", "user", "hey"),
        (1, 7, 1, "regenerate", "assistant", ""),
        (1, 8, 1, "delta", None, "bye"),
        (2, 1, 0, "delta", "user", "alone"),
    ]
    table = spark.createDataFrame(events, "conv_id long, seq long, turn long, op string, role string, text string").repartition(3)
    got = sorted(tuple(r) for r in chat.folded(table).collect())
    assert got == [(1, 0, "user", "hey"), (1, 1, "assistant", "bye"), (2, 0, "user", "alone")]


def test_surrogates(spark, none):
    rows = [
        (1, "Ask Anna.Weiss@corp.example.com, +1 (017) 555-7713 or 4485 2751 7886 6308; Mr. John Smith met Frau Müller."),
        (2, "ANNA.WEISS@corp.example.com 10.2.33.104 4485-2751-7886-6308 Господин Иван Петров"),
        (3, None),
        (4, "plain 12345 text"),
        (None, "10.2.33.104"),
        (5, "a1@b.co a2@b.co a3@b.co"),
        (5, "a1@b.co a2@b.co a3@b.co"),
    ]
    got = pii.with_surrogates(frame(spark, rows), "key").collect()
    by = {r["doc_id"]: r for r in got}
    one, two = by[1]["text"], by[2]["text"]
    assert len(got) == len(rows) and by[3]["text"] == "" and by[4]["text"] == "plain 12345 text"
    m = re.fullmatch(r"Ask (\w{4}\.\w{5}@\w{4}\.\w{7}\.com), \+1 \((\d{3})\) (\d{3})-(\d{4}) or (4\d{3} \d{4} \d{4} \d{4}); Mr\. (\w+) (\w+) met Frau (\w+)\.", one)
    assert m and m[1] != "Anna.Weiss@corp.example.com" and m[1][0].isupper() and re.fullmatch("[A-Z][a-z]+o", m[6]) and m[6] != "John"
    assert two.startswith(m[1].upper().split("@")[0]) and m[5].replace(" ", "-") in two and by[None]["text"] in two
    assert re.search(r"Господин ([А-Я][а-я]+ий) [А-Я][а-я]+$", two)
    assert len(set(by[5]["text"].split())) == 3
    again = {r["doc_id"]: r["text"] for r in pii.with_surrogates(frame(spark, rows[:1]), "other").collect()}
    assert again[1] != one
    assert pii.with_surrogates(none, "key").collect() == []


def test_names_go_together_and_letters_keep_their_script(spark):
    rows = [
        (1, "Mr. John Smith wrote to Frau Smith and Mr. Smith; Mr. James Smith, Mr. John Miller and Mr. Peter Jones came."),
        (2, "王小明@example.org שלום@example.org こんにちは@example.org 김철수@example.org"),
        (3, "Mr. John Smith. Господин Иван Петров and Господин Петров"),
    ]
    got = {r["doc_id"]: r["text"] for r in pii.with_surrogates(frame(spark, rows), "key").collect()}
    m = re.fullmatch(r"Mr\. (\S+) (\w+) wrote to Frau (\w+) and Mr\. (\w+); Mr\. (\S+) (\w+), Mr\. (\S+) (\w+) and Mr\. (\S+) (\w+) came\.", got[1])
    john, smith, frau, alone, james, smith2, john2, miller, peter, jones = m.groups()
    assert smith == frau == alone == smith2 and john == john2 and len({smith, miller, jones, "Smith", "Miller", "Jones"}) == 6 and len({john, james, peter, "John", "James", "Peter"}) == 6
    assert got[3].startswith(f"Mr. {john} {smith}. ")
    assert re.fullmatch(r".*Господин [А-Я]\S+ ([А-Я][а-я]+) and Господин \1", got[3])
    parts = [x.split("@")[0] for x in got[2].split()]
    for word, kind in zip(parts, ("\u4e00-\u9fff", "\u05d0-\u05ea", "\u3040-\u309f", "\uac00-\ud7a3"), strict=True):
        assert re.fullmatch(f"[{kind}]+", word)
    assert [len(x) for x in parts] == [3, 4, 5, 3] and not set(parts) & {x.split("@")[0] for x in rows[1][1].split()}


def test_names_never_run_out(spark):
    """Ten thousand given names of a gender, names that are spelled as surrogates are, and every script and gender."""
    spelled = ["".join(rng.choice(pii.SYLLABLES["latin"]) for _ in range(3)) for _ in range(3000)]
    rows = [("given", f"male n{i}") for i in range(10_000)] + [("given", f"female n{i}") for i in range(40)] + [("surname", x) for x in set(spelled)]
    rows += [("given", f"{sex} {word}{i}") for sex in ("male", "female") for word in ("иван", "νίκος", "明") for i in range(60)] + [("surname", "иванов"), ("surname", "παπάς")]
    out = pii.spelled_names(spark.createDataFrame(rows, "kind string, canon string"), "key").collect()
    assert sorted((r["kind"], r["canon"]) for r in out) == sorted(rows)
    assert len({r["core"].lower() for r in out if r["kind"] == "given"}) == 10_400 and len({r["core"].lower() for r in out if r["kind"] == "surname"}) == len(set(spelled)) + 2
    assert not {r["core"].lower() for r in out} & {r["canon"].split()[-1] for r in out}
    forms = {("иван", "male"): "[А-Я][а-я]+ий", ("иван", "female"): "[А-Я][а-я]+ия", ("νίκος", "male"): "[Α-Ω][α-ω]+ος", ("νίκος", "female"): "[Α-Ω][α-ω]+η", ("明", "male"): "[A-Z][a-z]+o", ("明", "female"): "[A-Z][a-z]+a"}
    for r in out:
        for (word, sex), form in forms.items():
            if r["kind"] == "given" and r["canon"].startswith(f"{sex} {word}"):
                assert re.fullmatch(form, r["core"])
    other = {r["canon"]: r["core"] for r in pii.spelled_names(spark.createDataFrame(rows[:50], "kind string, canon string"), "another key").collect()}
    same = {r["canon"]: r["core"] for r in pii.spelled_names(spark.createDataFrame(rows[:50], "kind string, canon string").repartition(3), "another key").collect()}
    assert same == other and sum(other[r["canon"]] == r["core"] for r in out if r["canon"] in other) < 10


def test_surrogates_of_a_generated_corpus(spark):
    """What is said of all entities at once: each has one surrogate, no two share one, none stays, and formats are kept."""
    first, last = [f"{a}{b}n" for a in ("Al", "Be", "Ce", "Do") for b in ("a", "e", "i", "o")], [f"{a}{b}k" for a in ("Ra", "Se", "Ti", "Vo") for b in ("a", "e", "i", "o", "u")]
    entities = []
    for i in range(400):
        entities.append(rng.choice([
            lambda: ("email", f"{rng.choice(first).lower()}.{i}@host{i % 7}.org"), lambda: ("ip", f"{rng.randrange(1, 255)}.{rng.randrange(255)}.{rng.randrange(255)}.{rng.randrange(255)}"),
            lambda: ("national", f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"), lambda: ("name", f"Mr. {rng.choice(first)} {rng.choice(last)}"), lambda: ("name", f"Frau {rng.choice(first)} {rng.choice(last)}"),
        ])())
    rows = [(k, " ; ".join(e for _, e in rng.sample(entities, 12))) for k in range(300)]
    got = {r["doc_id"]: r for r in pii.with_surrogates(frame(spark, rows), "key").collect()}
    pairs = {}
    for k, text in rows:
        old, new = text.split(" ; "), got[k]["text"].split(" ; ")
        assert len(old) == len(new) == got[k]["n_entities"]
        for a, b in zip(old, new, strict=True):
            pairs.setdefault(a, set()).add(b)
    assert all(len(x) == 1 for x in pairs.values())
    one = {a: next(iter(b)) for a, b in pairs.items()}
    assert len(set(one.values())) == len(one) and not set(one) & set(one.values())
    kinds = {e: k for k, e in entities}
    form = {"email": r"[a-z]+\.\d+@[a-z]+\d\.org", "ip": r"\d+(\.\d+){3}", "national": r"\d{3}-\d{2}-\d{4}", "name": r"(Mr\.|Frau) [A-Z][a-z]+ [A-Z][a-z]+"}
    parts = {}
    for a, b in one.items():
        assert re.fullmatch(form[kinds[a]], b) and len(a.split(".")[0]) > 0
        if kinds[a] == "name":
            (t, f, s), (t2, f2, s2) = a.split(), b.split()
            assert t == t2 and f2.endswith("o" if t == "Mr." else "a")
            assert parts.setdefault(("surname", s), s2) == s2 and parts.setdefault((t, f), f2) == f2


def test_collisions_are_drawn_again(spark):
    entities = spark.createDataFrame([("ip", f"{i}.{j}.1.1") for i in range(10) for j in range(10)], "kind string, canon string")
    rows = pii.drawn_surrogates(entities, "key").collect()
    cores = {r["core"] for r in rows}
    assert len(rows) == len(cores) == 100 and not cores & {r["canon"] for r in rows}


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def lines_by_force(rows):
    """(doc_id, text) -> (lines, dropped, links, text that stays); rows differ, and none has the doc_id of another."""
    split = {i: (t or "").split("\n") for i, t in rows}
    places = sorted((-1 if i is None else i, k, line, i) for i, ls in split.items() for k, line in enumerate(ls) if line.strip(" \t\r\f\v"))
    first = {}
    for i, k, line, _ in places:
        first.setdefault(line, (i, k))
    names, parent, links = sorted(first), {x: x for x in first}, dict.fromkeys(first, 0)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, x in enumerate(names):
        for y in names[n + 1 :]:
            may = min(2, min(len(x), len(y)) // 10)
            if abs(len(x) - len(y)) <= may and edit_distance(x, y) <= may:
                links[x] += 1
                links[y] += 1
                one, two = sorted((top(x), top(y)), key=first.get)
                parent[two] = one
    out = {}
    for i, ls in split.items():
        real = [bool(x.strip(" \t\r\f\v")) for x in ls]
        stays = [not r or first[top(x)] == (-1 if i is None else i, k) for k, (x, r) in enumerate(zip(ls, real, strict=True))]
        out[i] = (len(ls), stays.count(False), sum(links[x] for x, r in zip(ls, real, strict=True) if r), "\n".join(x for x, s in zip(ls, stays, strict=True) if s))
    return out, {x: top(x) for x in first}


def test_a_full_format_raises(spark):
    entities = spark.createDataFrame([("email", f"{a}@b.co") for a in "abcdefghijklmnopqrstuvwxyz" * 1] + [("email", f"{a}@{b}.co") for a in "abcdefghijklmnopqrstuvwxyz" for b in "acdefghijklmnopqrstuvwxyz"], "kind string, canon string")
    with pytest.raises(RuntimeError, match="email"):
        pii.drawn_surrogates(entities, "key", attempts=2)


def test_lines(spark, none):
    pool = []
    for _ in range(14):
        seed = "".join(rng.choice("abcde é") for _ in range(rng.choice([1, 4, 9, 10, 11, 15, 19, 20, 21, 22, 30, 61])))
        pool.append(seed)
        for _ in range(6):
            s = list(seed)
            for _ in range(rng.choice([1, 1, 2, 3])):
                k = rng.randrange(len(s)) if s else 0
                s[k : k + rng.choice([0, 1])] = rng.choice(["", "x", "y"])
            pool.append("".join(s))
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 9])))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, pool[0] + "\n \t\n" + pool[1]), (102, "\n\n x \n" + BASE + "\n" + BASE + "!"), (103, BASE[1:])]
    got = lines.near_duplicate_lines(frame(spark, rows)).collect()
    want, tops = lines_by_force(rows)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["n_links"], r["text"]) for r in got} == want and len(got) == len(rows)
    # Lines share a number if they are connected, and only then.
    numbers: dict[str, set] = {}
    texts = dict(rows)
    for r in got:
        for line, number in zip((texts[r["doc_id"]] or "").split("\n"), r["classes"], strict=True):
            assert (number is None) == (not line.strip(" \t\r\f\v"))
            if number is not None:
                numbers.setdefault(tops[line], set()).add(number)
    assert all(len(x) == 1 for x in numbers.values()) and len(set.union(*numbers.values())) == len(numbers)
    assert lines.near_duplicate_lines(none).collect() == []


def test_very_long_lines(spark):
    got = {r["doc_id"]: r for r in lines.near_duplicate_lines(frame(spark, [(1, LONG), (2, LONG[:-1] + "\n" + LONG[9:]), (3, LONG)])).collect()}
    assert got[1]["text"] == LONG and got[2]["text"] == LONG[9:] and got[3]["text"] == "" and [got[i]["n_links"] for i in (1, 2, 3)] == [1, 1, 1]


def test_lines_of_rows_that_share_a_doc_id(spark):
    one, two, three = ("".join(rng.choice("fghij") for _ in range(40)) for _ in range(3))
    rows = [(1, one + "\n" + two), (1, one + "\n" + two), (2, three), (2, two + "?"), (None, three), (None, one[:38])]
    got = sorted((str(r["doc_id"]), r["text"]) for r in lines.near_duplicate_lines(frame(spark, rows)).collect())
    assert got == sorted([("1", two), ("1", two), ("2", ""), ("2", ""), ("None", three), ("None", one[:38])])


def test_line_links_are_all_found(spark):
    pool = set()
    for _ in range(12):
        seed = "".join(rng.choice("abcde ") for _ in range(rng.randint(8, 30)))
        for _ in range(12):
            s = list(seed)
            for _ in range(rng.choice([1, 2, 3])):
                k = rng.randrange(len(s))
                s[k : k + rng.choice([0, 1])] = rng.choice(["", "x", "y"])
            pool.add("".join(s))
    rows = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(sorted(pool))], "id long, line string, n int")
    got = {tuple(r) for r in lines.line_links(rows).collect()}
    pairs = rows.alias("x").join(rows.alias("y"), F.col("x.id") < F.col("y.id")).where(F.expr("levenshtein(x.line, y.line) <= least(2, least(x.n, y.n) div 10)"))
    assert got == {tuple(r) for r in pairs.select("x.id", "y.id").collect()} and got


def test_mixing(spark, none):
    rows = [(i, "a plain sentence of words. " * (3 + i % 4)) for i in range(60)] + [(100 + i, "x | y | z ||| # $ " * (2 + i % 3)) for i in range(60)] + [(500, None), (None, "word")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(i, 0, 0) for i in range(100, 160, 2)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = mixing.mixed_rates(docs, labels, {0: 0.2, 1: 0.8}).toPandas()
    p = np.stack(got.posteriors)
    totals = (p * (got.tokens * got.rate).to_numpy()[:, None]).sum(0)
    assert len(got) == len(rows) and (got.rate >= 0).all() and abs(totals[1] / totals.sum() - 0.8) < 0.005
    kept = mixing.resampled(docs, mixing.fitted(docs, labels, {0: 0.2, 1: 0.8}, least_rate=1.0))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows}
    assert mixing.mixed_rates(none, labels, {1: 1.0}).collect() == []
    assert {r["rate"] for r in mixing.mixed_rates(docs, labels.limit(0), {1: 1.0}).collect()} == {1.0}


def test_rates_are_the_least_squares_ones(spark):
    """Against projected gradients on plain numbers, where the targets can be met and where a least rate keeps them out of reach."""
    rows = [(i, "a plain sentence of words. " * (3 + i % 4)) for i in range(40)] + [(100 + i, "x | y | z ||| # $ " * (2 + i % 3)) for i in range(40)] + [(200 + i, "half | a sentence. " * 4) for i in range(9)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(i, 0, 0) for i in range(100, 140, 2)], "doc_id long, quality int, toxic int")
    for shares, how in (({0: 0.25, 1: 0.75}, {}), ({0: 0.25, 1: 0.75}, {"least_rate": 1.0, "total": 400.0})):
        got = mixing.mixed_rates(frame(spark, rows), labels, shares, **how).toPandas()
        p, t, rate = np.stack(got.posteriors), got.tokens.to_numpy(float), got.rate.to_numpy()
        mass = (p * t[:, None]).sum(0)
        total = how.get("total") or max(m / shares[k] for k, m in enumerate(mass))
        goal = np.array([shares[0], shares[1]]) * total
        loss = lambda r: float((((p * (t * r)[:, None]).sum(0) - goal) ** 2 / mass).sum())  # noqa: B023, E731
        best, floor = np.ones(len(t)), how.get("least_rate", 0.0)
        for _ in range(3000):
            best = np.maximum(floor, best - p @ (((p * (t * best)[:, None]).sum(0) - goal) / mass))
        assert (rate >= floor).all() and loss(rate) <= loss(best) + 1e-5 * total


def test_a_large_vector_raises(spark):
    table = spark.createDataFrame([(50, [1.0, 2.0]), (51, [3e15, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.exact_top_k(table, F.col("vec_id") % 50 == 0).collect()


def test_top_k_reads_only_annuli_within_the_bound(spark, monkeypatch):
    """Far clusters: exact, and most annuli are never looked into."""
    monkeypatch.setattr(topk, "ANNULUS", 4)
    numbers = np.random.default_rng(6)
    v = np.concatenate([numbers.normal(0, 0.01, (60, 4)) + 2 * np.eye(4)[c] for c in range(4)])
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(500 + i, [2.0, 0.0, 0.0, 0.0]) for i in range(30)]
    looked = []
    keep = topk.written
    monkeypatch.setattr(topk, "written", lambda df, name: keep(df, name) if name != "visits" else looked.append(keep(df, name)) or looked[-1])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_top_k(table, F.col("vec_id") % 20 == 0).collect())
    whole = {i: np.floor(256 * np.array(x)) for i, x in rows}
    want = [(q, n + 1, i, -s) for q in whole if q % 20 == 0 for n, (s, i) in enumerate(sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q)[:5])]
    assert got == sorted(want)
    visits = sum(x.count() for x in looked)
    assert len(looked) == 3 and visits < len({q for q, *_ in want}) * len(rows) / 4 / 2


def test_top_k(spark):
    numbers = np.random.default_rng(2)
    rows = [(i, [float(x) for x in numbers.normal(0, 0.1, 8)]) for i in range(300)] + [(1000 + i, [0.5] * 8) for i in range(40)]
    rows += [(50, None), (2000, [None] * 8), (2050, [float("nan")] * 8), (2100, [float("inf")] + [0.0] * 7), (2150, [1.0, 2.0]), (None, [0.1] * 8), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got: dict[int, list] = {}
    for r in topk.exact_top_k(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and len(v) == 8]
    for q in (100, 250, 1000):
        v = dict(good)[q]
        assert got[q] == [(-s, i) for s, i in sorted((-int(v @ w), i) for i, w in good if i != q)[:5]]
    # Two rows of one vec_id: each meets the other.
    assert len(got[0]) == 10 and any(i == 0 for _, i in got[0]) and 2050 not in got and 2150 not in got
    assert topk.exact_top_k(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    few = table.where("vec_id in (100, 101)")
    assert [tuple(r)[:3] for r in topk.exact_top_k(few, F.col("vec_id") % 50 == 0).collect()] == [(100, 1, 101)]
