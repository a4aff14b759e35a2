"""Chunks of documentation, code and issue threads."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relayscope.functions.text import slug

#: Tokens of a chunk, and what two neighbours share.
MOST, OVERLAP, SHORT = 512, 48, 100
RUN = 5
Count = Callable[[str], int]
TOKEN = re.compile(r"\w+|[^\w\s]")


def words(text: str) -> int:
    """The default count of tokens: words and marks."""
    return sum(1 for _ in TOKEN.finditer(text))


def comment_runs(comments: DataFrame, order: Sequence[str], bots: Sequence[str] = ()) -> DataFrame:
    """issue, run, comments, content: the comments of people, RUN at a time."""
    people = comments.where(~F.col("author").isin(*bots)) if bots else comments
    n = F.row_number().over(Window.partitionBy("issue").orderBy(*order))
    rows = people.withColumn("n", n).withColumn("run", F.floor((F.col("n") - 1) / RUN))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"])
    return rows.groupBy("issue", "run").agg(F.count("*").alias("comments"), F.array_join(bodies, "\n").alias("content"))


def sections(markdown: str) -> Iterator[tuple[list[str], str | None, str]]:
    """(headings above, anchor, text) of each section; lines in fences are no headings."""
    path: list[tuple[int, str]] = []
    anchor, lines, fence = None, [], None
    for line in markdown.splitlines():
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark:
            fence = None if fence and mark[1].startswith(fence) else fence or mark[1]
        heading = None if fence or mark else re.match(r"(#{1,6})[ \t]+(.*?)(?:[ \t]*\{[ \t]*#([\w-]+)[ \t]*\})?[ \t]*#*[ \t]*$", line)
        if not heading:
            lines.append(line)
            continue
        if any(x.strip() for x in lines):
            yield [t for _, t in path], anchor, "\n".join(lines).strip()
        path = [p for p in path if p[0] < len(heading[1])] + [(len(heading[1]), heading[2])]
        anchor, lines = heading[3], []
    if any(x.strip() for x in lines):
        yield [t for _, t in path], anchor, "\n".join(lines).strip()


def packed(units: Sequence[str], most: int, overlap: int, count: Count = words) -> Iterator[str]:
    """Units joined up to ``most`` tokens. A part begins with the end of the last one, unless the next unit then wouldn't fit."""
    part: list[str] = []
    for unit in units:
        if part and count("\n\n".join([*part, unit])) > most:
            yield "\n\n".join(part)
            tail: list[str] = []
            for old in reversed(part):
                if count("\n\n".join([old, *tail])) > overlap:
                    break
                tail.insert(0, old)
            part = tail if count("\n\n".join([*tail, unit])) <= most else []
        part.append(unit)
    if part:
        yield "\n\n".join(part)


def units(text: str, most: int, count: Count = words) -> Iterator[str]:
    """Paragraphs; lines of those that are too long, and windows of words of lines that are."""
    for paragraph in re.split(r"\n\s*\n", text):
        if count(paragraph) <= most:
            yield from [paragraph] * bool(paragraph.strip())
            continue
        for line in paragraph.splitlines():
            if count(line) <= most:
                yield from [line] * bool(line.strip())
            else:
                yield from pieces(line, most)


def pieces(line: str, most: int) -> Iterator[str]:
    """A line without anything to cut at, in pieces of ``most`` words and marks that share OVERLAP; a run of letters longer than that is cut too."""
    spans = [(at, min(at + MOST, m.end())) for m in TOKEN.finditer(line) for at in range(m.start(), m.end(), MOST)]
    step = max(1, most - OVERLAP)
    for i in range(0, len(spans), step):
        yield line[spans[i][0] : spans[min(i + most, len(spans)) - 1][1]]
        if i + most >= len(spans):
            return


def merged_sections(markdown: str, count: Count = words) -> list[tuple[list[str], str | None, str]]:
    """Sections of under SHORT tokens go in front of the next one, which then loses its own anchor; a last one stays."""
    out: list[tuple[list[str], str | None, str]] = []
    before = ""
    for headings, anchor, text in sections(markdown):
        whole = f"{before}\n\n{text}" if before else text
        if count(whole) < SHORT:
            before, held = whole, headings
            continue
        out.append((headings, None if before else anchor, whole))
        before = ""
    if before:
        out.append((held, None, before))
    return out


def doc_chunks(path: str, markdown: str, most: int = MOST, count: Count = words) -> Iterator[tuple[str, str, str]]:
    """(id, breadcrumb, content) of a page, each content under its breadcrumb; a repeated id gets -2, -3 and so on that no other has."""
    taken: set[str] = set()
    for headings, anchor, text in merged_sections(markdown, count):
        crumb = " > ".join(headings) or path
        head = f"# {crumb}\n\n"
        room = max(64, most - 16 - count(head))
        for content in packed(list(units(text, room, count)), room, OVERLAP, count):
            base = f"docs:{path}#{anchor or slug(headings[-1] if headings else path) or 'top'}"
            name, n = base, 1
            while name in taken:
                n += 1
                name = f"{base}-{n}"
            taken.add(name)
            yield name, crumb, head + content


def line_windows(lines: Sequence[str], first: int, most: int, count: Count = words) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text): as many lines as fit; a longer line is one of its own."""
    start, held = first, []
    for number, line in enumerate(lines, first):
        if held and count("\n".join([*held, line])) > most:
            yield start, number - 1, "\n".join(held)
            start, held = number, []
        held.append(line)
    if any(x.strip() for x in held):
        yield start, first + len(lines) - 1, "\n".join(held)


def spans_of(source: str) -> Iterator[tuple[int, int]]:
    """Lines of a module's functions, of its classes up to their first method, of methods, and of assignments."""
    begin = lambda node: min([node.lineno, *(x.lineno for x in getattr(node, "decorator_list", []))])
    for node in ast.parse(source).body:
        if isinstance(node, ast.ClassDef):
            methods = [x for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
            yield begin(node), begin(methods[0]) - 1 if methods else node.end_lineno
            yield from ((begin(x), x.end_lineno) for x in methods)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Assign | ast.AnnAssign):
            yield begin(node), node.end_lineno


def code_parts(path: str, source: str, most: int = MOST, count: Count = words) -> Iterator[tuple[str, str]]:
    """(id, content) of a module; one that isn't Python is cut into windows of lines."""
    lines = source.splitlines()
    try:
        found = list(spans_of(source))
    except (SyntaxError, ValueError, RecursionError):
        found = [(1, len(lines))]
    for a, b in found:
        for first, last, text in line_windows(lines[a - 1 : b], a, most, count):
            pieces = list(units(text, most, count)) if count(text) > most else [text]
            for n, piece in enumerate(pieces):
                yield f"code:{path}:L{first}-L{last}" + (f"#part-{n}" if len(pieces) > 1 else ""), piece


def doc_sections(pages: DataFrame) -> DataFrame:
    """path, id, breadcrumb, content of the chunks of Markdown pages (path, content)."""

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *c) for p, text in zip(batch.path, batch.content, strict=True) for c in doc_chunks(p, text or "")]
            yield pd.DataFrame(rows, columns=["path", "id", "breadcrumb", "content"])

    return pages.select("path", "content").mapInPandas(chunked, "path string, id string, breadcrumb string, content string")


def code_chunks(files: DataFrame) -> DataFrame:
    """path, id, content of the chunks of Python files (path, content)."""

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *c) for p, text in zip(batch.path, batch.content, strict=True) for c in code_parts(p, text or "")]
            yield pd.DataFrame(rows, columns=["path", "id", "content"])

    return files.select("path", "content").mapInPandas(chunked, "path string, id string, content string")
