"""Surrogates for personal data, by DataFrame functions alone.

Detected entities get replacements that a secret key determines: of the same
kind and format (separators, case, lengths, card check digits), names of the
same gender and script. An entity has one replacement wherever it occurs,
however it is written (coreference), and no two entities of a kind share one,
nor is one an entity of the corpus itself (distinctness). Names are spelled from
syllables, as many as their number needs: their ranks go through a keyed
permutation of all such spellings, so that names never run out. Of other kinds,
whose format is their own, what collides is drawn again with the next attempt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayscope.llm.merkle import placed
from relayscope.llm.shared import written

# Titles by gender, and name parts by script and gender.
TITLES = {
    "male": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"),
    "female": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Señora", "Госпожа", "Κυρία"),
}
SYLLABLES = {
    "latin": ("ba", "cor", "del", "fen", "gar", "hol", "kin", "lam", "mer", "nor", "pal", "rin", "sol", "tam", "ven", "wal"),
    "cyrillic": ("ба", "вер", "гор", "дем", "жар", "зор", "кал", "лев", "мир", "нов", "пал", "рад", "сол", "тар", "фед", "шор"),
    "greek": ("βα", "γερ", "δημ", "ζαρ", "θεο", "κων", "λαμ", "μαρ", "νικ", "παπ", "ραλ", "σπυ", "τσα", "φωτ", "χρι", "ψαλ"),
}
#: How names end that are spelled by syllables, by script: surnames, and given names by gender.
ENDINGS = {
    "latin": {"surname": "", "male": "o", "female": "a"},
    "cyrillic": {"surname": "", "male": "ий", "female": "ия"},
    "greek": {"surname": "", "male": "ος", "female": "η"},
}
#: Syllables of a surname and of a given name at least.
LEAST_SYLLABLES = {"surname": 3, "given": 2}
ALPHABETS = {
    "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "latin": "abcdefghijklmnopqrstuvwxyz",
}
#: Scripts of so many letters that a code point is drawn: its first one, and how many follow that are all letters.
RANGES = {"han": (0x4E00, 20_000), "hangul": (0xAC00, 11_000)}
# What each kind looks like, the first that fits at a place.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
TITLE = "|".join(t for ts in TITLES.values() for t in ts)
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\b(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d+])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "national": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": rf"\b(?:{TITLE})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
#: Kinds whose punctuation is only a way of writing.
DIGITS_ONLY = ("card", "phone", "national")
ANY = "|".join(p.replace(r"([ -]?)", r"(?<gap>[ -]?)").replace(r"\1", r"\k<gap>") for p in KINDS.values())


def kind_of(value: Column) -> Column:
    """The kind of a detected entity: told by its own form, as its surroundings are gone."""
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(F.rlike(value, F.lit(rf"^(?:{TITLE})\.? ")), "name")
        .when(F.rlike(value, F.lit(rf"^(?:{OCTET}\.){{3}}{OCTET}$")), "ip")
        .when(F.rlike(value, F.lit(r"^\d{3}-\d{2}-\d{4}$")), "national")
        .when(F.rlike(value, F.lit(r"^\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}$")), "card")
        .when(F.rlike(value, F.lit(r"^[+(]|^\d{3}[.-]")), "phone")
        .otherwise("secret")
    )


def canonical(kind: Column, value: Column) -> Column:
    """One form for all ways to write an entity; names keep title and case apart."""
    return (
        F.when(kind.isin(*DIGITS_ONLY), F.regexp_replace(value, r"\D", ""))
        .when(kind == "email", F.lower(value))
        .when(kind == "name", F.concat(gender(value), F.lit(" "), F.lower(F.regexp_replace(value, rf"^(?:{TITLE})\.? ", ""))))
        .otherwise(value)
    )


def gender(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit(rf"^(?:{'|'.join(TITLES['female'])})\b")), "female").otherwise("male")


def script(text: Column) -> Column:
    """The first of the scripts that a letter of ``text`` is of; letters of none count as Latin."""
    out = F.lit("latin")
    for name in reversed([n for n in (*ALPHABETS, *RANGES) if n != "latin"]):
        out = F.when(F.rlike(text, F.lit(rf"\p{{Is{name.capitalize()}}}")), name).otherwise(out)
    return out


def drawn(digest: Column, i: Column, n: int) -> Column:
    """A number below n from the digest's bits for place i."""
    return F.conv(F.substr(digest, (F.pmod(i * 5, F.lit(58)) + 1).cast("int"), F.lit(7)), 16, 10).cast("long") % n


def lettered(digest: Column, i: Column, letter: Column) -> Column:
    """A letter of the same script."""

    def picked_letter(x: Column) -> Column:
        out = F.lit("")
        for name, alphabet in ALPHABETS.items():
            out = F.when(x["script"] == name, F.substr(F.lit(alphabet), (drawn(digest, i, len(alphabet)) + 1).cast("int"), F.lit(1))).otherwise(out)
        for name, (first, n) in RANGES.items():
            out = F.when(x["script"] == name, F.decode(F.unhex(F.hex(first + drawn(digest, i, n))), "UTF-16BE")).otherwise(out)
        return out

    return F.get(F.transform(F.array(F.struct(script(letter).alias("script"))), picked_letter), F.lit(0))


def spelled(canon: Column, digest: Column, hexadecimal: Column, keep: Column) -> Column:
    """``canon`` with each letter and digit drawn anew, in its script; ``keep``: for places that stay."""

    def one(c: Column, i: Column) -> Column:
        letter = F.when(hexadecimal, F.substr(F.lit("abcdef"), (drawn(digest, i, 6) + 1).cast("int"), F.lit(1))).otherwise(lettered(digest, i, c))
        return (
            F.when(i < keep, c)
            .when(F.rlike(c, F.lit(r"\d")), drawn(digest, i, 10).cast("string"))
            .when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(letter))
            .when(F.rlike(c, F.lit(r"\p{L}")), letter)
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def luhn(digits: Column) -> Column:
    """The sum that a valid card number has as a multiple of 10."""
    n = F.length(digits)
    each = F.transform(
        F.split(digits, ""),
        lambda c, i: F.when(c == "", 0).when(F.pmod(n - i, F.lit(2)) == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def name_script(canon: Column) -> Column:
    """The script that a name is spelled in: one that SYLLABLES has, Latin for others."""
    return F.when(script(canon) == "cyrillic", "cyrillic").when(script(canon) == "greek", "greek").otherwise("latin")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def permuted(number: Column, key: str, tag: Column, bits: Column) -> Column:
    """A keyed permutation of the numbers below 2 ** ``bits`` (at most 60): odd multiples, sums and shifts, three times."""
    half = (1 << 30) - 1

    def turned(x: Column, digest: Column) -> Column:
        factor = F.conv(F.substr(digest, F.lit(1), F.lit(7)), 16, 10).cast("long").bitwiseOR(F.lit(1).cast("long"))
        added = F.conv(F.substr(digest, F.lit(9), F.lit(7)), 16, 10).cast("long")
        # A product by halves, so that none overflows.
        product = x.bitwiseAND(F.lit(half)) * factor + F.shiftleft((F.shiftright(x, 30) * factor).bitwiseAND(F.lit(half)), 30)
        kept = (product + added).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
        return bound(kept, lambda y: y.bitwiseXOR(F.call_function("shiftright", y, F.greatest(F.floor(bits / 2).cast("int"), F.lit(1)))))

    digests = F.transform(F.array(*map(F.lit, "012")), lambda turn: F.sha2(F.concat_ws("|", F.lit(key), tag, turn), 256))
    return F.aggregate(digests, number.cast("long"), turned)


def syllabled(number: Column, syllables: Column, of: Column, ending: Column) -> Column:
    """The name of a number: a syllable for each of its hexadecimal digits, and an ending.

    No two syllables of a script begin alike, so that no two numbers have the same name.
    """
    digits = F.transform(F.sequence(F.lit(0), syllables - 1), lambda i: F.call_function("shiftright", number, (i * 4).cast("int")).bitwiseAND(F.lit(15).cast("long")).cast("int"))
    table = F.create_map(*(x for name, parts in SYLLABLES.items() for x in (F.lit(name), F.array(*map(F.lit, parts)))))
    spelled_out = bound(F.struct(F.try_element_at(table, of).alias("words"), digits.alias("digits")), lambda x: F.transform(x["digits"], lambda d: F.get(x["words"], d)))
    return F.initcap(F.concat(F.array_join(spelled_out, ""), ending))


def spelled_names(names: DataFrame, key: str) -> DataFrame:
    """kind, canon, core for each of ``names`` (kind: surname or given, canon; distinct), whatever their number.

    A format is a kind, a script and a gender. Its n names are ranked by keyed
    digests and spelled with so many syllables that there are four times as many
    spellings at least. Each rank offers two numbers to the permutation; what is
    a name of the corpus itself goes, which leaves n at least, and the rest is
    dealt out by rank. Formats end differently, so their names differ too.
    """
    own = F.lower(F.substring_index("canon", " ", -1))
    sex = F.when(F.col("kind") == "surname", "surname").otherwise(F.substring_index("canon", " ", 1))
    rows = names.select("kind", "canon", own.alias("low"), F.concat_ws("|", "kind", name_script(F.col("canon")), sex).alias("format"))
    rows = written(rows.withColumn("order", F.sha2(F.concat_ws("|", F.lit(key), "format", "canon"), 256)), "names")
    ranked = written(placed(rows, "format", "order", "canon"), "ranked")
    of, ending = F.split_part("format", F.lit("|"), F.lit(2)), F.lit("")
    for name, ends in ENDINGS.items():
        for gender_, end in ends.items():
            ending = F.when((of == name) & (F.split_part("format", F.lit("|"), F.lit(3)) == gender_), end).otherwise(ending)
    least = F.when(F.startswith("format", F.lit("surname")), LEAST_SYLLABLES["surname"]).otherwise(LEAST_SYLLABLES["given"])
    syllables = F.greatest(least, F.ceil(F.log(4.0 * (F.col("n") + 1)) / F.log(F.lit(16.0)))).cast("int")
    offered = ranked.select("format", "n", F.explode(F.array(F.col("place") * 2, F.col("place") * 2 + 1)).alias("number")).withColumn("syllables", syllables)
    core = bound(permuted(F.col("number"), key, F.col("format"), F.col("syllables") * 4), lambda p: syllabled(p, F.col("syllables"), of, ending))
    free = offered.select("format", "number", core.alias("core")).join(rows.select(F.col("low").alias("known")).distinct(), F.lower("core") == F.col("known"), "left_anti")
    dealt = placed(written(free, "free"), "format", "number").select(F.col("format").alias("its_format"), F.col("place").alias("its_place"), "core")
    return ranked.join(dealt, (F.col("format") == F.col("its_format")) & (F.col("place") == F.col("its_place"))).select("kind", "canon", "core")


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The replacement of a canonical entity."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), canon), 256)
    octets = F.transform(
        F.split(canon, r"\."),
        lambda o, i: F.when(F.length(o) == 3, 100 + drawn(digest, i, 156)).when(F.length(o) == 2, 10 + drawn(digest, i, 90)).otherwise(drawn(digest, i, 10)).cast("string"),
    )
    top = F.substring_index(canon, ".", -1)
    email = F.concat(spelled(F.substr(canon, F.lit(1), F.length(canon) - F.length(top)), digest, F.lit(False), F.lit(0)), top)
    card = spelled(canon, digest, F.lit(False), F.lit(1))
    body = F.substr(card, F.lit(1), F.length(card) - 1)
    check = F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    # A prefix that tells the kind of a secret, or a phone's first digit, stays.
    stays = F.when(kind == "phone", 1).otherwise(F.length(F.regexp_extract(canon, r"^(AKIA|gh[pousr]_|sk-)", 1)))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "card", F.when(luhn(canon) % 10 == 0, F.concat(body, check)).otherwise(card))
        .otherwise(spelled(canon, digest, F.rlike(canon, F.lit("^[0-9a-fA-F]+$")), stays))
    )


def written_as(kind: Column, value: Column, core: Column) -> Column:
    """``core`` in the way that ``value`` is written."""
    chars = F.split(value, "")
    place = lambda i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda c: F.rlike(c, F.lit(r"\d"))))
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(F.rlike(c, F.lit(r"\d")), F.substr(core, place(i), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(
        F.transform(chars, lambda c, i: F.when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(F.substr(core, i + 1, F.lit(1)))).otherwise(F.substr(core, i + 1, F.lit(1)))), ""
    )
    return (
        F.when(kind.isin(*DIGITS_ONLY), digits)
        .when(kind == "email", cased)
        .when(kind == "name", F.concat(F.regexp_extract(value, rf"^((?:{TITLE})\.? )", 1), core))
        .otherwise(core)
    )


def drawn_surrogates(entities: DataFrame, key: str, attempts: int = 200) -> DataFrame:
    """kind, canon, core for each of ``entities`` (kind, canon; distinct): all cores of a kind differ.

    Each round draws for those that are left. A core is taken if no entity and
    no earlier core is the same, and of several that agree the smallest canon
    has it. A format that is so full that ``attempts`` rounds leave entities
    without one raises; no surrogate leaves its entity's format.
    """
    taken, left = None, entities.withColumn("attempt", F.lit(0))
    own = entities.select("kind", F.lower("canon").alias("low"))
    for _ in range(attempts):
        core = surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))
        drawn_rows = left.withColumn("core", core).withColumn("low", F.lower("core"))
        first = F.row_number().over(Window.partitionBy("kind", "low").orderBy("canon")) == 1
        fresh = drawn_rows.withColumn("first", first)
        used = own if taken is None else own.union(taken.select("kind", F.lower("core").alias("low")))
        fresh = written(fresh.join(used.withColumn("used", F.lit(True)).distinct(), ["kind", "low"], "left"), "surrogates")
        good = fresh.where("first and used is null").select("kind", "canon", "core")
        taken = good if taken is None else taken.union(good)
        bad = fresh.where("not first or used").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if bad.isEmpty():
            return taken
        left = bad
    kinds = [f"{r['n']} of kind {r['kind']}" for r in left.groupBy("kind").agg(F.count("*").alias("n")).collect()]
    raise RuntimeError(f"no surrogates left in the formats of {', '.join(kinds)}")


def with_surrogates(documents: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_entities, kinds of each row of ``documents``, the text with surrogates.

    kinds: those of the entities, in their order. Whole texts are searched; null
    counts as empty. A replacement depends on the key and on the corpus, not on
    the row, so repeated rows and null doc_ids come out alike. An empty table
    gives an empty result; other columns are not read.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = F.rlike("text", F.lit(ANY))
    found = written(
        texts.where(some).withColumn("digest", F.sha2("text", 256)).withColumn("values", F.regexp_extract_all("text", F.lit(ANY), F.lit(0))),
        "private",
    )
    places = found.select("digest", F.posexplode("values").alias("place", "value")).distinct().withColumn("kind", kind_of(F.col("value")))
    places = written(places.withColumn("canon", canonical(F.col("kind"), F.col("value"))), "entities")
    # A name is its given name and its surname, so that a surname alone goes with the full name.
    words = F.split("canon", " ")
    names = places.where("kind = 'name'").withColumns({"surname": F.element_at(words, -1), "given": F.when(F.size(words) > 2, F.concat_ws(" ", words[0], words[1]))})
    others = places.where("kind <> 'name'")
    parts = names.select(F.explode(F.array(F.struct(F.lit("surname").alias("kind"), F.col("surname").alias("canon")), F.struct(F.lit("given").alias("kind"), F.col("given").alias("canon")))).alias("p")).select("p.*")
    cores = drawn_surrogates(others.select("kind", "canon").distinct(), key).union(spelled_names(parts.where("canon is not null").distinct(), key))
    of = lambda kind: cores.where(F.col("kind") == kind).select(F.col("canon").alias(kind), F.col("core").alias(f"{kind}_core"))
    whole = names.join(of("surname"), "surname").join(of("given"), "given", "left").withColumn("core", F.concat_ws(" ", "given_core", "surname_core"))
    columns = ("digest", "place", "value", "kind", "core")
    replaced = others.join(cores, ["kind", "canon"]).select(*columns).union(whole.select(*columns)).withColumn("new", written_as(F.col("kind"), F.col("value"), F.col("core")))
    by_text = replaced.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("place", "new", "kind"))).alias("new"))
    # The pieces between the entities, each but the first after an entity.
    pieces = F.split("text", ANY, -1)
    joined = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform("new", lambda e, i: F.concat(e["new"], F.get(pieces, i + 1))), ""))
    changed = found.join(by_text, "digest").select(
        "doc_id", joined.alias("text"), F.size("new").cast("long").alias("n_entities"), F.transform("new", lambda e: e["kind"]).alias("kinds")
    )
    return changed.union(texts.where(~some).select("doc_id", "text", F.lit(0).cast("long"), F.array().cast("array<string>")))
