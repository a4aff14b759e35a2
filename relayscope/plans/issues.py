"""Chunks of issues, with packing by recursion in the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from relayscope.operators import issues
from relayscope.plans.model import read

QUERIES, ORACLES = {}, {}
MOST, OVERLAP, LEAST = 90, 20, 30
W = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'"


def tok(x: str) -> str:
    return f"len(regexp_extract_all({x}, {W}))"


def units(text: str, room: str) -> str:
    lines = r"list_filter(regexp_split_to_array({p}, '\r\n|[\n\r]'), lambda x: regexp_matches(x, '\S'))".replace("{p}", "p")
    windows = f"list_transform(range(0, {tok('l')}, greatest(1, {room} - {OVERLAP})), lambda a: array_to_string(regexp_extract_all(l, {W})[a + 1:a + {room}], ' '))"
    by_lines = f"flatten(list_transform(CASE WHEN len({lines}) > 1 THEN {lines} ELSE [p] END, lambda l: CASE WHEN {tok('l')} <= {room} THEN [l] ELSE {windows} END))"
    paragraphs = rf"list_filter(regexp_split_to_array({text}, '\n\s*\n'), lambda x: regexp_matches(x, '\S'))"
    return f"CASE WHEN len({paragraphs}) = 0 THEN [{text}] ELSE flatten(list_transform({paragraphs}, lambda p: CASE WHEN {tok('p')} <= {room} THEN [p] ELSE {by_lines} END)) END"


def fold(name: str, source: str) -> str:
    """``name`` (g, u, parts): ``source`` (g, u: units, room) packed, a unit at a time."""
    tail = f"list_filter(range(0, len(held) + 1), lambda m: coalesce(list_sum(list_transform(held[len(held) - m + 1:], lambda x: sizes[x + 1])), 0) <= {OVERLAP})[-1]"
    size = "coalesce(list_sum(list_transform(held[len(held) - m + 1:], lambda x: sizes[x + 1])), 0)"
    return f"""{name}_sized AS (SELECT g, u, room, list_transform(u, lambda x: {tok('x')}) AS sizes FROM {source}),
    {name}_steps AS (
        SELECT g, u, room, sizes, 0::BIGINT AS i, []::BIGINT[][] AS parts, []::BIGINT[] AS held, 0::BIGINT AS total FROM {name}_sized
        UNION ALL
        SELECT g, u, room, sizes, i + 1, CASE WHEN goes THEN list_append(parts, held) ELSE parts END, list_append(CASE WHEN NOT goes THEN held WHEN fits THEN held[len(held) - m + 1:] ELSE [] END, i), (CASE WHEN NOT goes THEN total WHEN fits THEN tail ELSE 0 END) + sizes[i + 1] + 1
        FROM (SELECT *, {size} AS tail, {size} + sizes[i + 1] + 1 <= room AS fits FROM (SELECT *, len(held) > 0 AND total + sizes[i + 1] + 1 > room AS goes, {tail} AS m FROM {name}_steps WHERE i < len(u)))
    ), {name} AS (SELECT g, u, list_append(parts, held) AS parts FROM {name}_steps WHERE i = len(u))"""


def joined(part: str) -> str:
    return f"array_to_string(list_transform({part}, lambda i: u[i + 1]), chr(10) || chr(10))"


STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
HEAD = r"'# Thread ' || conv_id"
ORACLE = rf"""WITH RECURSIVE threads AS (SELECT conv_id, {HEAD} || chr(10) || 'labels: ' || conv_id % 3 || ', long' AS header, string_agg(text, chr(10) || chr(10) ORDER BY turn, role) FILTER (turn < 4) AS body FROM conversations GROUP BY conv_id),
    bodies AS (SELECT conv_id AS g, {units(STRIP.format(x="coalesce(body, '')"), 'room')} AS u, room FROM (SELECT *, greatest({LEAST}, {MOST} - {tok('header')}) AS room FROM threads)),
    {fold('body_parts', 'bodies')},
    body_rows AS (SELECT g, header, n, {STRIP.format(x="header || chr(10) || " + joined('parts[n]'))} AS content FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM body_parts) JOIN threads ON conv_id = g),
    said AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n, {STRIP.format(x='text')} AS text, greatest({LEAST}, {MOST} - {tok(HEAD)}) AS room FROM conversations WHERE role <> 'system' AND regexp_matches(coalesce(text, ''), '\S')),
    pieces AS (SELECT conv_id || ':' || n AS g, {units('text', '(room - 8)')} AS u, room - 8 AS room FROM said),
    {fold('piece_parts', 'pieces')},
    runs AS (SELECT conv_id || ':' || (n - 1) // 5 AS g, any_value(room) AS room, list('@' || role || ': ' || piece ORDER BY n, k) AS u, list(n ORDER BY n, k) AS ns FROM (SELECT s.*, k, {joined('parts[k]')} AS piece FROM said s JOIN (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM piece_parts) p ON p.g = s.conv_id || ':' || s.n) GROUP BY 1),
    {fold('thread_parts', 'runs')},
    thread_rows AS (SELECT split_part(t.g, ':', 1)::BIGINT AS conv_id, split_part(t.g, ':', 2)::BIGINT AS run, p, ns[parts[p][1] + 1] AS a, ns[parts[p][-1] + 1] AS b, {joined('parts[p]')} AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS p FROM thread_parts) t JOIN (SELECT g, ns FROM runs) USING (g))
    SELECT id, issue, anchor, content, {tok('content')}::INT AS tokens FROM (
        SELECT 'issue:' || g || '#body' || CASE WHEN n = 1 THEN '' ELSE '-' || n - 1 END AS id, g AS issue, 'Thread ' || g || CASE WHEN n = 1 THEN '' ELSE ' (body ' || n || ')' END AS anchor, content FROM body_rows
        UNION ALL SELECT 'issue:' || conv_id || '#comment-' || row_number() OVER (PARTITION BY conv_id ORDER BY run, p) - 1, conv_id, 'Thread ' || conv_id || ' (comments ' || a || '-' || b || ')', {HEAD} || chr(10) || chr(10) || text FROM thread_rows)"""


def issue_chunks(s, d):
    """Conversations as issues: their first turns are the body, all turns of people the comments."""
    rows = read(s, d, "conversations").select(F.col("conv_id").alias("issue"), "turn", F.col("role").alias("author"), F.col("text").alias("body"))
    first = F.array_sort(F.collect_list(F.when(F.col("turn") < 4, F.struct("turn", "author", "body"))))
    whole = rows.groupBy("issue").agg(F.array_join(F.transform(first, lambda x: x["body"]), "\n\n").alias("body"))
    about = whole.select("issue", F.concat(F.lit("Thread "), F.col("issue").cast("string")).alias("title"), "body", F.array(F.lit("long"), (F.col("issue") % 3).cast("string")).alias("labels"))
    sizes = {"most": MOST, "overlap": OVERLAP, "least": LEAST}
    return issues.body_chunks(about, **sizes).unionByName(issues.thread_chunks(about, rows, ["turn", "author"], bots=("system",), **sizes))


QUERIES["issue_chunks"], ORACLES["issue_chunks"] = issue_chunks, ORACLE
