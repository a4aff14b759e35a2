from pyspark.sql import functions as F

from relayscope.functions import text as T
from relayscope.operators import chunking


def column(spark, values, expression):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(expression(F.col("x"))).collect()]


def test_identifiers(spark):
    cases = {
        "read_table": ["read", "table"],
        "sparkSQLContext": ["spark", "sql", "context"],
        "XMLFile": ["xml", "file"],
        "rowID": ["row", "id"],
        "__init_subclass__": ["init", "subclass"],
        "toB64": ["to", "64"],
        "getV2": [],
        "x1Y2": [],
        "a_b_c": [],
        "utf8Bytes": ["utf8", "bytes"],
        "HTML": [],
        "table": [],
    }
    assert column(spark, cases, T.identifier_parts) == list(cases.values())


def test_identifiers_in_texts(spark):
    texts = ["The loadAll of rowID, load_all; é_loadAll and loadAllé don't count", "plain words", ""]
    assert column(spark, texts, T.decomposed) == [["all", "id", "load", "load_all", "loadall", "row", "rowid"], [], []]


def test_citations(spark):
    cases = {
        "docs:guide/setup.md#install-it": ("docs", True),
        "code:lib/io/reader.py:L5-L9": ("code", True),
        "code:lib/io/reader.py:L5-L9#part-3": ("code", True),
        "issue:8#comment-77": ("comment", True),
        "issue:8#body-2": ("body", True),
        "pr:5": ("pr", False),
        "commit:0123abc": ("commit", False),
        "issue:99999999999999999999": ("issue", False),
        "release:v3-rc1": ("release", False),
    }
    got = column(spark, cases, T.citation)
    assert [(c["kind"], c["is_span"]) for c in got] == list(cases.values())
    assert got[7]["number"] is None and got[2]["index"] == 3
    wrong = ["docs:guide/setup.md", "code:reader.py:5-9", "issue:x", "pr:5a", "commit:0123ab", "release:", "issues:1", " pr:5", None]
    assert column(spark, wrong, T.citation) == [None] * len(wrong)


def test_citations_in_prose(spark):
    text = "It came with pr:5 (see `docs:a b.md#c`, [issue:8]); pr:5, again, \"commit:0123abc\"! But xpr:6, pr: 7 and `no pr:9` are none."
    assert column(spark, [text, "", None], T.citations_in) == [["pr:5", "docs:a b.md#c", "issue:8", "commit:0123abc"], [], None]


def test_slugs(spark):
    titles = ["  Über uns -- 2. Teil!", "naïve façade", "Ωmega ½", "???", None]
    assert column(spark, titles, T.slugify) == ["uber-uns-2-teil", "naive-facade", "mega-12", "", None]


def test_a_long_line_is_cut_by_tokens():
    line = "a.b," * 3000
    parts = list(chunking.units(line, 512))
    assert all(chunking.words(p) <= 512 for p in parts) and parts[0] == line[: len(parts[0])] and parts[-1] == line[-len(parts[-1]) :]
    assert sum(map(len, parts)) >= len(line)


def test_token_windows(spark):
    rows = spark.createDataFrame([(list("abcdefg"),), (list("abc"),), ([],)], "t array<string>")
    got = [r[0] for r in rows.select(T.token_windows(F.col("t"), 3, 1)).collect()]
    assert got == [[list("abc"), list("cde"), list("efg")], [list("abc")], []]


def test_sections_know_fences_anchors_and_short_ones():
    page = "# A {#a}\n\nintro\n\n## B\n\n" + "word " * 120 + "\n\n```\n# no heading\n```\n\n## B\n\n" + "more " * 120 + "\n\n## C {#c}\n\n" + "tail " * 150
    chunks = list(chunking.doc_chunks("p.md", page))
    assert [c[0] for c in chunks] == ["docs:p.md#b", "docs:p.md#b-2", "docs:p.md#c"]
    assert chunks[0][1] == "A > B" and "intro" in chunks[0][2] and "# no heading" in chunks[0][2]


def test_a_suffix_that_is_taken_is_skipped():
    body = "\n\n" + "word " * 120
    ids = [c[0] for c in chunking.doc_chunks("p", f"# A{body}\n# A-2{body}\n# A{body}")]
    assert ids == ["docs:p#a", "docs:p#a-2", "docs:p#a-3"]


def test_packing_keeps_an_overlap_only_if_it_fits():
    count = lambda t: len(t.split())
    assert list(chunking.packed(["a b", "c", "d e", "f g h i"], 4, 2, count)) == ["a b\n\nc", "c\n\nd e", "f g h i"]


def test_code_chunks():
    source = 'import os\nX = 1\nclass A:\n    """doc"""\n    def f(self):\n        return 1\n    def g(self):\n        return 2\ndef h():\n    pass\n'
    assert [i for i, _ in chunking.code_parts("m.py", source)] == ["code:m.py:L2-L2", "code:m.py:L3-L4", "code:m.py:L5-L6", "code:m.py:L7-L8", "code:m.py:L9-L10"]
    assert [i for i, _ in chunking.code_parts("m.py", "def broken(:\n  x")] == ["code:m.py:L1-L2"]


def test_message_text(spark):
    raw = ["plain", '[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]', ""]
    assert column(spark, raw, T.message_text) == ["plain", "a\nb", ""]


def test_queries_are_named_without_a_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], check=True)
