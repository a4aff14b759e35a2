"""Near-duplicate lines by a segment-partition edit join, by DataFrame functions alone.

Of two lines, the shorter one's length says how many edits they may be apart:
one for each CHARS_AN_EDIT characters, up to EDITS. A line that may have e edits
has e + 1 segments, which are of one size for a class of 2 * (e + 1) lengths. A
line within e edits of it has one of the segments unchanged, at one of a few
places that the lengths of both lines allow; so the index holds each line's
segments with the class of its length, and each line probes it with substrings of
its own for the lengths from its own down to e less, which are of two classes at
most as long as e is small.

Most keys have one line and are dropped in semi-joins of keys and ids, before
anything else of a line moves. Lines that meet get counts of their letters, of
which two edits change few, and only pairs near in those are put together and
verified with a banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayscope.llm.components import connected_components
from relayscope.llm.shared import dropped, row_keys, written

EDITS, CHARS_AN_EDIT = 2, 10
# Frequent letters, whose numbers tell most lines apart before they are compared.
LETTERS = ("eaintrso", "hldcumpg")
#: A line that has nothing but such white space is blank.
SAYS = r"[^ \t\r\f\x0B]"
#: Steps in which equal beginnings and ends of two lines are left out; together they reach over 2^17 characters.
STEPS = tuple(1 << k for k in range(16, 2, -1))


def allowed(length: Column, edits: int) -> Column:
    """The edits that a line may be apart from one that is no shorter."""
    return F.least(F.lit(edits), F.floor(length / CHARS_AN_EDIT)).cast("int")


def probes(edits: int) -> list[tuple[int, int, int, int, int]]:
    """(e, less, i, shift, before): substrings that a line has at segment i, moved by shift, of a line that is ``less`` shorter and may have e edits.

    before: the next smaller ``less`` with a substring at the same place, which is the same one if both lengths are of a class; -1 if there is none.
    """
    out = []
    for e in range(edits + 1):
        places: dict[tuple[int, int], int] = {}
        for less in range(e + 1):
            for i in range(e + 1):
                # At most i edits before the segment, and at most e - i after it.
                lowest, highest = max(-i, less - (e - i)), min(i, less + (e - i))
                if less == 0 and e <= 2:
                    # Lines of one length look for each other. If they share no first or last segment, one character goes
                    # in before the middle and one out behind it: each has the other's middle, and one of them moved up.
                    lowest = 0
                for shift in range(lowest, highest + 1):
                    # The last segment lies at a place from the end.
                    place = (i, shift - less if i == e else shift)
                    out.append((e, less, i, shift, places.get(place, -1)))
                    places[place] = less
    return out


def keys(lines: DataFrame, edits: int, segments_only: bool) -> DataFrame:
    """key, id: of all probes of ``lines`` (id, line, n), or of the lines' own segments."""
    every = [p for p in probes(edits) if not segments_only or p[1] == p[3] == 0]
    longest = [p for p in every if p[0] == edits]

    def constant(some: list[tuple[int, int, int, int, int]]) -> Column:
        return F.array(*(F.struct(*(F.lit(x).alias(name) for name, x in zip(("e", "less", "i", "shift", "before"), p, strict=True))) for p in some))

    e, n, shorter, parts = F.col("e"), F.col("n"), F.col("n") - F.col("less"), F.col("e") + 1
    which = F.when(n >= edits * CHARS_AN_EDIT + edits, constant(longest)).otherwise(constant(every))
    rows = lines.select("id", "line", "n", F.explode(which).alias("p")).select("id", "line", "n", "p.*")
    # The least length of a class; the segments have their size from it, and longer lines have a gap before the last one.
    least = lambda length: length - (length - e * CHARS_AN_EDIT) % (2 * parts)
    size = F.floor(least(shorter) / parts).cast("int")
    start = F.when(F.col("i") == e, shorter - size).otherwise(size * F.col("i")) + F.col("shift") + 1
    earlier = n - F.col("before")
    new = (F.col("before") < 0) | (allowed(earlier, edits) != e) | (least(earlier) != least(shorter))
    # Lines that may have no edit are linked with nothing, as no two lines are equal.
    rows = rows.where((e > 0) & (allowed(shorter, edits) == e) & new & (start >= 1) & (start + size - 1 <= n))
    # Where each character is a byte, it is found without counting those before it.
    segment = F.when(F.octet_length("line") == n, F.substr(F.col("line").cast("binary"), start, size)).otherwise(F.substr("line", start, size).cast("binary"))
    return rows.select(F.xxhash64("i", least(shorter), segment).alias("key"), "id")


def letter_counts(line: Column, letters: str) -> Column:
    """The numbers of ``letters`` in a line, up to 255, a byte each."""
    out = F.lit(0).cast("long")
    for k, letter in enumerate(letters):
        n = F.least(F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit(""))), F.lit(255)).cast("long")
        out = out.bitwiseOR(F.shiftleft(n, 8 * k))
    return out


def letters_apart(a: Column, b: Column) -> Column:
    """By how much the letters' numbers differ: at most two for each edit."""
    byte = lambda x, k: F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))
    return sum((F.abs(byte(a, k) - byte(b, k)) for k in range(8)), F.lit(0))


def without_common_ends(a: Column, b: Column, edits: int) -> Column:
    """a and b without most of what they begin and end with alike, which keeps their distance; more than ``edits`` characters stay of each."""

    def shorter(s: Column, h: Column, end: bool) -> Column:
        a, b = s["a"], s["b"]
        cut = F.right if end else F.left
        rest = lambda x: F.left(x, F.length(x) - h) if end else F.substr(x, h + 1)
        return F.when((F.least(F.length(a), F.length(b)) > h + edits) & (cut(a, h) == cut(b, h)), F.struct(rest(a).alias("a"), rest(b).alias("b"))).otherwise(s)

    steps = F.array(*map(F.lit, STEPS))
    begun = F.aggregate(steps, F.struct(a.alias("a"), b.alias("b")), lambda s, h: shorter(s, h, False))
    return F.aggregate(steps, begun, lambda s, h: shorter(s, h, True))


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of a and b if it is up to ``edits``; otherwise a larger number.

    Bit-parallel, after Hyyrö (2003). A word holds the band of b's places around
    the place in a, which move on by one with each character of a; its bits are
    the vertical differences. The distance is followed down the band's last
    diagonal, and then along b's last row. The lengths may differ by ``edits``.
    """
    width = 2 * edits + 2
    full = (1 << width) - 1
    bits = F.array(*(F.lit(1 << k).cast("long") for k in range(width)))
    blank = F.lit(None).cast("string")
    places = F.concat(F.array_repeat(blank, edits + 1), F.split(b, ""), F.array_repeat(blank, width))
    no = F.lit(0).cast("long")

    def state(vp: Column, vn: Column, d: Column, i: Column, row: Column) -> Column:
        return F.struct(vp.cast("long").alias("vp"), vn.cast("long").alias("vn"), d.cast("int").alias("d"), i.cast("int").alias("i"), row.cast("long").alias("row"))

    def inverse(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(F.lit(full).cast("long"))

    def next_state(s: Column, c: Column, text: Column) -> Column:
        window = F.slice(text["places"], s["i"] + 1, F.lit(width))
        same = F.aggregate(F.zip_with(window, bits, lambda w, bit: F.when(w == c, bit).otherwise(no)), no, lambda x, y: x.bitwiseOR(y))
        return F.aggregate(F.array(same), s, lambda s, x: moved(s, x, text["turn"]))

    def moved(s: Column, x: Column, turn: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full).cast("long"))
        hp, hn = vn.bitwiseOR(inverse(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
        down = F.shiftrightunsigned(d0, 1)
        has = lambda word, mask: F.when(word.bitwiseAND(mask) != 0, 1).otherwise(0)
        diagonal = s["i"] < turn
        d = F.when(diagonal, s["d"] + 1 - has(d0, F.lit(1 << (width - 1)).cast("long"))).otherwise(s["d"] + has(hp, s["row"]) - has(hn, s["row"]))
        row = F.when(diagonal, s["row"]).otherwise(F.shiftrightunsigned(s["row"], 1))
        return state(hn.bitwiseOR(inverse(down.bitwiseOR(hp))), down.bitwiseAND(hp), d, s["i"] + 1, row)

    start = state(F.lit(full & ~((1 << (width - edits - 1)) - 1)), no, F.lit(edits), F.lit(0), F.lit(1 << (width - 2)))
    # Within the lambda the characters are values; written out, they would be split again for each step.
    texts = F.array(F.struct(F.split(a, "").alias("a"), places.alias("places"), (F.length(b) - edits).alias("turn")))
    return F.get(F.transform(texts, lambda t: F.aggregate(t["a"], start, lambda s, c: next_state(s, c, t))["d"]), F.lit(0))


def line_links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """a, b (ids, a < b) of the pairs of ``lines`` (id, line, n: characters; distinct lines) that are as near as their lengths allow."""
    index, probing = keys(lines, edits, True), keys(lines, edits, False)
    other = lambda rows: rows.select(F.col("key").alias("k"), F.col("id").alias("other"))
    meets = (F.col("key") == F.col("k")) & (F.col("id") != F.col("other"))
    # The probes, which are the most, move once.
    hits = written(probing.join(other(index), meets, "left_semi"), "hits")
    met = written(hits.withColumn("own", F.lit(False)).union(index.join(other(hits), meets, "left_semi").withColumn("own", F.lit(True))), "met")
    # How many lines meet has no bound, so they are not sent to all tasks.
    named = lines.join(met.select("id").distinct().hint("merge"), "id", "left_semi")
    named = written(named.select("id", "line", "n", *(letter_counts(F.col("line"), x).alias(f"l{k}") for k, x in enumerate(LETTERS))), "named")
    sides = met.join(named.select("id", "n", "l0", "l1"), "id")
    # A class has several lengths: here each line meets only those that are as long or as much shorter as they may be.
    a = sides.where("own").select("key", F.col("n").alias("shorter"), *(F.col(c).alias(f"a_{c}") for c in ("id", "l0", "l1")))
    b = sides.where("not own").withColumn("less", F.explode(F.array(*map(F.lit, range(edits + 1))))).withColumn("shorter", F.col("n") - F.col("less"))
    b = b.where(F.col("less") <= allowed(F.col("shorter"), edits)).select("key", "shorter", *(F.col(c).alias(f"b_{c}") for c in ("id", "l0", "l1")))
    far = letters_apart(F.col("a_l0"), F.col("b_l0")) + letters_apart(F.col("a_l1"), F.col("b_l1"))
    near = (F.col("a_id") != F.col("b_id")) & (far <= 2 * allowed(F.col("shorter"), edits))
    pairs = a.join(b, ["key", "shorter"]).where(near).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()
    whole = pairs.join(named.select(F.col("id").alias("a"), F.col("line").alias("one"), F.col("n").alias("an")), "a")
    whole = whole.join(named.select(F.col("id").alias("b"), F.col("line").alias("two"), F.col("n").alias("bn")), "b")
    # Within the lambda the ends are values, as the characters are in banded_distance.
    ends = F.array(without_common_ends(F.col("one"), F.col("two"), edits))
    distance = F.get(F.transform(ends, lambda t: banded_distance(t["a"], t["b"], edits)), F.lit(0))
    return whole.where(distance <= allowed(F.least("an", "bn"), edits)).select("a", "b")


def near_duplicate_lines(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_links, classes and text of each row of ``documents``.

    Lines end at \\n; blank ones stay and take no part. Lines are equal, or
    linked within as many edits as the shorter one allows: one for each
    CHARS_AN_EDIT characters, up to ``edits``, so that lines under CHARS_AN_EDIT
    characters have to be equal. Of lines that equality and links connect, the one
    that comes first (smallest doc_id, then place) stays and the others go.
    n_links: of a document's lines, the links that their texts have to different
    texts. classes: for each line, a number that connected lines share; null for
    blank ones. text: the lines that stay. A null text counts as empty, one blank
    line. Rows of one doc_id with different texts are documents of their own, in
    the order of 63 hashed bits of their texts; equal rows share one result. A
    null doc_id comes before all others. An empty table gives an empty result;
    other columns are not read.
    """
    row, name = ["doc", "text_key"], ["h1", "h2"]
    texts = row_keys(documents)
    each = texts.select(*row, F.posexplode(F.split("text", "\n")).alias("place", "line")).where(F.col("line").rlike(SAYS))
    # 128 bits stand for a line where only equality matters.
    each = each.select(*row, "place", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    lines = each.groupBy(*name).agg(F.min(F.struct(*row, "place")).alias("first"), F.first("line").alias("line"), F.count("*").alias("times"))
    lines = written(lines.select(*name, "first", "line", "times", F.length("line").alias("n"), F.monotonically_increasing_id().alias("id")), "lines")
    links = written(line_links(lines.select("id", "line", "n"), edits), "links")
    components = written(connected_components(links), "components")
    degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    # Lines that repeat or have links; the others need no decision.
    light = lines.select(*name, "first", "times", "id").join(components, "id", "left").join(degrees, "id", "left")
    light = light.where("times > 1 or links > 0").withColumn("component", F.coalesce("component", "id"))
    firsts = light.groupBy("component").agg(F.min(F.struct("first", "h1")).alias("f")).select("component", "f.first", F.col("f.h1").alias("class"))
    classes = light.drop("first").join(firsts, "component").select(*name, "first", "class", F.coalesce("links", F.lit(0)).alias("links"))
    # A set: each of many equal rows tells of the same places.
    decided = each.select(*row, "place", *name).join(written(classes, "classes"), name)
    decided = decided.select(*row, F.struct("place", "class", "links", (F.struct(*row, "place") != F.col("first")).alias("gone")).alias("it"))
    by_row = written(decided.groupBy(*row).agg(F.collect_set("it").alias("its")), "decided")
    dropped(lines)
    all_lines = F.split("text", "\n")
    gone = F.transform(F.filter("its", lambda x: x["gone"]), lambda x: x["place"])
    marked = texts.join(by_row, row, "left").withColumns({"lines": all_lines, "its": F.coalesce("its", F.array().cast("array<struct<place:int,class:bigint,links:bigint,gone:boolean>>"))})
    marked = marked.withColumns({"gone": gone, "of_place": F.map_from_entries(F.transform("its", lambda x: F.struct(x["place"], x["class"])))})
    number = lambda x, i: F.when(x.rlike(SAYS), F.coalesce(F.element_at("of_place", i), F.xxhash64(x)))
    return marked.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.aggregate("its", F.lit(0).cast("long"), lambda n, x: n + x["links"]).alias("n_links"),
        F.transform("lines", number).alias("classes"),
        F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)), "\n").alias("text"),
    )
