"""Queries of retrieval, tools, memories, index maintenance, turns and metrics, each with its oracle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from relayscope.functions import text as T
from relayscope.operators import memory, metrics, retrieval, sync, turns
from relayscope.operators.lineage import checkpointed, new_path
from relayscope.plans import model
from relayscope.plans.model import chunks, read, sql

QUERIES, ORACLES = {}, {}
NOW = datetime(2024, 6, 1)
#: The query vector of the ranked queries is that of this vec_id.
PROBE = 7


def query(oracle: str | None = None, *tables: str, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = sql(oracle, *tables) if tables else oracle
        return f

    return keep


def probe(s, d):
    return retrieval.vector(read(s, d, "embeddings").where(F.col("vec_id") == PROBE).first()["embedding"])


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


COS = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_inner_product({b}::DOUBLE[], {b}::DOUBLE[])))"
Q = f"(SELECT embedding FROM embeddings WHERE vec_id = {PROBE})"
SIM = COS.format(a="embedding", b=Q)
DENSE = f"SELECT id, {SIM} AS score FROM chunks {{where}} ORDER BY score DESC, id LIMIT 50"


@query(f"SELECT id, round(score, 6) AS score FROM ({DENSE.format(where='')})", "chunks")
def dense_topk(s, d):
    return rounded(retrieval.dense_topk(chunks(s, d), probe(s, d)), "score")


@query(f"SELECT id, round(score, 6) AS score FROM ({DENSE.format(where="WHERE source = 'en'")})", "chunks")
def dense_topk_source(s, d):
    return rounded(retrieval.dense_topk(chunks(s, d), probe(s, d), source="en"), "score")


@query(f"SELECT id, round(score, 6) AS score FROM ({DENSE.format(where='')}) ORDER BY score DESC, id LIMIT 10", "chunks")
def dense_only(s, d):
    return rounded(retrieval.hybrid_search(chunks(s, d), probe(s, d)), "score")


def tools(s, d):
    e = read(s, d, "embeddings")
    return e.select(F.concat(F.lit("tool"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("name"), (F.col("vec_id") % 3 != 0).alias("dispatchable"), "embedding", F.col("label").alias("description"))


TOOLS = "tools AS (SELECT 'tool' || lpad(vec_id::VARCHAR, 6, '0') AS name, vec_id % 3 <> 0 AS dispatchable, embedding, label AS description FROM embeddings)"
CHOSEN = f"chosen AS (SELECT name, score FROM (SELECT name, dispatchable, {SIM} AS score FROM tools WHERE {SIM} >= 0.25 ORDER BY score DESC, name LIMIT 5) WHERE {{where}})"


@query(f"WITH {TOOLS}, {CHOSEN.format(where='true')} SELECT name, round(score, 6) AS score FROM chosen")
def tool_select(s, d):
    return rounded(retrieval.select_tools(tools(s, d).withColumn("dispatchable", F.lit(True)), probe(s, d)), "score")


@query(f"WITH {TOOLS}, {CHOSEN.format(where='dispatchable')} SELECT name, round(score, 6) AS score FROM chosen")
def tool_select_dispatchable(s, d):
    return rounded(retrieval.select_tools(tools(s, d), probe(s, d)), "score")


@query(
    f"""WITH {TOOLS}, {CHOSEN.format(where='dispatchable')} SELECT name, round(score, 6) AS score FROM chosen
    UNION ALL SELECT name, NULL FROM tools WHERE name IN ('tool000001', 'tool000002') AND name NOT IN (SELECT name FROM chosen)"""
)
def tool_select_injected(s, d):
    return rounded(retrieval.select_tools(tools(s, d), probe(s, d), always=("tool000001", "tool000002")), "score")


@query(f"""WITH {TOOLS} SELECT name, '{{"name":"' || name || '","description":' || description || CASE WHEN name IN ('tool000003') THEN ',"defer_loading":true' ELSE '' END || '}}' AS payload FROM tools""")
def tool_native_defer(s, d):
    return retrieval.tool_payload(tools(s, d), deferred=("tool000003",))


@query(
    f"""SELECT query, id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query, c.id, {COS.format(a='c.embedding', b='q.embedding')} AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format(a='c.embedding', b='q.embedding')} DESC, c.id)::INT AS rank FROM chunks c, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 5""",
    "chunks",
)
def batch_topk(s, d):
    questions = read(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return rounded(retrieval.batch_topk(chunks(s, d), questions, 5).select("query", "id", "score", "rank"), "score")


# --- memories ---------------------------------------------------------------


def memories(s, d):
    i = F.col("vec_id")
    kind = F.when(i % 3 == 0, "semantic").when(i % 3 == 1, "episodic").otherwise("procedural")
    start = F.lit(datetime(2024, 1, 1)) + F.make_dt_interval((i % 150).cast("int"))
    return read(s, d, "embeddings").select(
        i.alias("id"),
        (i % 5).alias("user_id"),
        kind.alias("mem_type"),
        F.concat(F.lit("memory "), i.cast("string"), F.lit(" of "), F.col("label").cast("string")).alias("content"),
        F.array(F.concat(F.lit("e"), F.col("label").cast("string")), F.lit("all")).alias("entities"),
        ((i % 10 + 1) / 10.0).alias("confidence"),
        F.lit(1).alias("revision"),
        start.alias("valid_from"),
        F.when(i % 11 == 0, start + F.make_dt_interval(F.lit(7))).alias("valid_to"),
        F.lit("agent").alias("created_by"),
        F.concat(F.lit("s"), (i % 7).cast("string")).alias("source_session_id"),
        F.slice(F.array(F.lit("s1"), F.lit("s2")), F.lit(1), (i % 3).cast("int")).alias("source_ids"),
        "embedding",
    )


MEM = """memories AS (SELECT vec_id AS id, vec_id % 5 AS user_id, CASE vec_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' ELSE 'procedural' END AS mem_type,
    'memory ' || vec_id || ' of ' || label AS content, (vec_id % 10 + 1) / 10.0::DOUBLE AS confidence, 1 AS revision, TIMESTAMP '2024-01-01' + to_days((vec_id % 150)::INT) AS valid_from,
    CASE WHEN vec_id % 11 = 0 THEN TIMESTAMP '2024-01-01' + to_days((vec_id % 150 + 7)::INT) END AS valid_to, 'agent' AS created_by,
    's' || vec_id % 7 AS source_session_id, vec_id % 3 AS n_sources, embedding FROM embeddings)"""
AGE = "(epoch(TIMESTAMP '2024-06-01') - epoch(valid_from)) / 86400.0"


@query(f"WITH {MEM} SELECT id, valid_from FROM memories WHERE valid_to IS NULL AND mem_type = 'semantic'")
def memory_live(s, d):
    return memory.live(memories(s, d), "semantic").select("id", "valid_from")


def rank_query(kind: str, half_life: float | None, k: int, weighted: bool):
    extra = (f" * pow(0.5, {AGE} / {half_life})" if half_life else "") + (" * confidence" if weighted else "")

    @query(
        f"""WITH {MEM} SELECT id, round(score, 6) AS score FROM (SELECT id, {SIM}{extra} AS score FROM memories
        WHERE valid_to IS NULL AND user_id = 2 AND mem_type = '{kind}' ORDER BY score DESC, id LIMIT {k})""",
        name=f"memory_rank_{kind}",
    )
    def run(s, d):
        return rounded(memory.ranked(memories(s, d), 2, kind, probe(s, d), F.lit(NOW), k, half_life, weighted).select("id", "score"), "score")


rank_query("semantic", 180.0, 20, True)
rank_query("episodic", 30.0, 20, False)
rank_query("procedural", None, 5, False)

CONF = f"confidence * pow(0.5, greatest({AGE}, 0) / 180.0)"
LINE = f"""'[' || CASE mem_type WHEN 'semantic' THEN 'semantic · conf ' || printf('%.1f', {CONF}) || CASE n_sources WHEN 0 THEN '' WHEN 1 THEN ' · from 1 session' ELSE ' · from ' || n_sources || ' sessions' END
    WHEN 'episodic' THEN 'episodic · ' || strftime(valid_from, '%Y-%m-%d') || ' · ' || source_session_id ELSE 'procedural' END || '] ' || content"""


@query(f"WITH {MEM} SELECT id, round({CONF}, 6) AS confidence FROM memories")
def effective_confidence(s, d):
    return memories(s, d).select("id", F.round(memory.effective_confidence(F.col("confidence"), F.col("valid_from"), F.lit(NOW)), 6).alias("confidence"))


@query(f"WITH {MEM} SELECT id, {LINE} AS line FROM memories")
def render_memory(s, d):
    return memories(s, d).select("id", memory.rendered(F.lit(NOW)).alias("line"))


@query(
    f"""WITH {MEM} SELECT user_id, id FROM (SELECT *, sum(ceil(length(content) / 3.5::DOUBLE)) OVER (PARTITION BY user_id ORDER BY valid_from DESC, id ROWS UNBOUNDED PRECEDING) AS total
    FROM memories WHERE valid_to IS NULL) WHERE total <= 60"""
)
def memory_pack(s, d):
    rows = memories(s, d).where("valid_to is null").withColumn("cost", T.estimated_tokens(F.col("content")))
    return memory.packed(rows, 60, ["user_id"], [F.desc("valid_from"), "id"]).select("user_id", "id")


PROFILE = f"""profile AS (SELECT user_id, list(x ORDER BY place) AS mean FROM (SELECT user_id, place, avg(x) AS x FROM (SELECT user_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place
    FROM memories WHERE valid_to IS NULL AND mem_type = 'semantic') GROUP BY 1, 2) GROUP BY 1)"""


VECTOR = f"""mine AS (SELECT list_transform(range(1, 65), lambda i: (q[i] + mean[i] / sqrt(list_inner_product(mean, mean))) / 2) AS v FROM profile, (SELECT embedding AS q FROM embeddings WHERE vec_id = {PROBE}) WHERE user_id = 2)"""
BUDGET = 400


def part_sql(kind: str, half: float | None, k: int, share: float, place: int) -> str:
    semantic = kind == "semantic"
    floor = f"WHERE {CONF} >= 0.3" if semantic else ""
    score = (COS.format(a="embedding", b="(SELECT v FROM mine)") if semantic else SIM) + (f" * pow(0.5, {AGE} / {half})" if half else "") + (" * confidence" if semantic else "")
    inner = f"SELECT *, {score} AS score FROM memories WHERE valid_to IS NULL AND user_id = 2 AND mem_type = '{kind}' ORDER BY score DESC, id LIMIT {k}"
    lines = f"SELECT id, mem_type, {place} AS place, score, {LINE} AS line FROM ({inner}) {floor}"
    return f"SELECT * FROM (SELECT *, sum(ceil(length(line) / 3.5::DOUBLE)) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS total FROM ({lines})) WHERE total <= {int(BUDGET * share)}"


BLOCK = " UNION ALL ".join(part_sql(*x) for x in (("semantic", 180.0, 20, 0.5, 0), ("episodic", 30.0, 20, 0.3, 1), ("procedural", None, 5, 0.2, 2)))
IN_BLOCK = f"""WITH {MEM}, {PROFILE}, {VECTOR}, parts AS ({BLOCK}), fitting AS (SELECT id, mem_type, place, score, line FROM (SELECT *, sum(length(line) + 1) OVER (ORDER BY place, score DESC, id ROWS UNBOUNDED PRECEDING) AS size FROM parts)
    WHERE ceil((size + {len(memory.PREAMBLE)} + 1) / 3.5::DOUBLE) <= {BUDGET})"""


@query(f"{IN_BLOCK} SELECT id, mem_type, place, line FROM fitting")
def memory_block(s, d):
    return memory.block(memories(s, d), 2, probe(s, d), F.lit(NOW), BUDGET).select("id", "mem_type", "place", "line")


TEXT = f"'{memory.PREAMBLE}' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY place, score DESC, id)"


@query(f"{IN_BLOCK} SELECT {TEXT} AS text, ceil(length({TEXT}) / 3.5::DOUBLE)::BIGINT AS tokens FROM fitting")
def memory_block_text(s, d):
    return memory.block_text(memory.block(memories(s, d), 2, probe(s, d), F.lit(NOW), BUDGET))


@query(f"WITH {MEM}, {PROFILE} SELECT user_id, list_transform(mean, lambda x: round(x / sqrt(list_inner_product(mean, mean)), 6)) AS profile FROM profile")
def profile_vector(s, d):
    return memory.profile_vector(memories(s, d)).select("user_id", F.transform("profile", lambda x: F.round(x, 6)).alias("profile"))


@query(
    f"""WITH {MEM}, {PROFILE}, halves AS (SELECT user_id, list_transform(range(1, 65), lambda i: (q[i] + mean[i] / sqrt(list_inner_product(mean, mean))) / 2) AS v FROM profile, (SELECT embedding AS q FROM embeddings WHERE vec_id = {PROBE}))
    SELECT user_id, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6)) AS vector FROM halves"""
)
def blended_query(s, d):
    p = memory.profile_vector(memories(s, d))
    return p.select("user_id", F.transform(memory.blended(probe(s, d), F.col("profile")), lambda x: F.round(x, 6)).alias("vector"))


@query(
    f"""WITH {MEM} SELECT id, mem_type, round(score, 6) AS score FROM (SELECT id, mem_type, score, row_number() OVER (PARTITION BY mem_type ORDER BY score DESC, id) AS rank FROM (SELECT id, mem_type, {SIM} AS score FROM memories WHERE valid_to IS NULL AND user_id = 2)) WHERE rank <= 4"""
)
def memory_search_all(s, d):
    parts = [memory.ranked(memories(s, d), 2, kind, probe(s, d), F.lit(NOW), 4).select("id", "mem_type", "score") for kind in memory.HALF_LIFE]
    return rounded(parts[0].union(parts[1]).union(parts[2]), "score")


@query(
    f"""WITH {MEM} SELECT id, revision::BIGINT AS revision, created_by, CASE WHEN id = 5 AND revision = 1 THEN TIMESTAMP '2024-06-01' ELSE valid_to END AS valid_to FROM memories
    UNION ALL SELECT id, 2, 'human', NULL FROM memories WHERE id = 5"""
)
def memory_revert(s, d):
    return memory.reverted(memories(s, d), 5, 1, NOW).select("id", F.col("revision").cast("long").alias("revision"), "created_by", "valid_to")


@query(f"WITH {MEM} SELECT id, revision::BIGINT AS revision, content FROM memories WHERE id = 5 UNION ALL SELECT id, 2, content FROM memories WHERE id = 5")
def memory_history(s, d):
    return memory.history(memory.reverted(memories(s, d), 5, 1, NOW), 5).select("id", F.col("revision").cast("long").alias("revision"), "content")


PAYLOAD = """'{"id":' || id || ',"revision":' || revision || ',"user_id":' || user_id || ',"mem_type":"' || mem_type || '","content":"' || content || '","confidence":' || confidence || ',"created_by":"' || created_by || '"}'"""
WRITES = f"""writes AS (SELECT id + 1000000000 AS id, 1 AS revision, user_id, 'episodic' AS mem_type, 'again ' || content AS content, 0.8::DOUBLE AS confidence, 'agent' AS created_by,
    CASE id % 4 WHEN 0 THEN id WHEN 1 THEN -id - 1 END AS supersedes FROM memories), good AS (SELECT w.*, m.id AS old, m.revision AS old_revision FROM writes w LEFT JOIN memories m ON m.id = w.supersedes AND m.valid_to IS NULL WHERE w.supersedes IS NULL OR m.id IS NOT NULL)"""


def writes(s, d):
    """Every memory said again under a new id; a fourth supersede the memory, a fourth one that there isn't."""
    i = F.col("id")
    said = memories(s, d).select(
        (i + 1_000_000_000).alias("id"), "user_id", F.lit("s9").alias("session_id"), F.concat(F.lit("again "), F.col("content")).alias("statement"), F.lit(None).cast("string").alias("mem_type"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<string>").alias("entities"), "embedding", F.when(i % 4 == 0, i).when(i % 4 == 1, -i - 1).alias("supersedes"), F.lit(NOW).alias("at"),
    )
    return memory.recorded(said)


@query(
    f"""WITH {MEM}, {WRITES} SELECT m.id, content, mem_type, confidence, CASE WHEN m.valid_to IS NULL AND g.id IS NOT NULL THEN TIMESTAMP '2024-06-01' ELSE m.valid_to END AS valid_to,
    CASE WHEN m.valid_to IS NULL THEN g.id END AS superseded_by FROM memories m LEFT JOIN (SELECT old, id FROM good WHERE old IS NOT NULL) g ON g.old = m.id UNION ALL SELECT id, content, mem_type, confidence, NULL, NULL FROM good"""
)
def memory_write(s, d):
    return memory.stored_after(memories(s, d), writes(s, d)).select("id", "content", "mem_type", "confidence", "valid_to", "superseded_by")


@query(f"WITH {MEM}, {WRITES} SELECT id, 'no live memory ' || supersedes AS error FROM writes WHERE id NOT IN (SELECT id FROM good)")
def memory_write_refused(s, d):
    return memory.refused(memories(s, d), writes(s, d))


FOLDED = f"""WITH {MEM}, w AS (SELECT id, user_id, id % 3 = 0 AS semantic, CASE id % 4 WHEN 0 THEN id END AS supersedes, list_reverse(embedding) AS embedding FROM memories WHERE id % 4 <> 1), good AS (SELECT w.* FROM w LEFT JOIN memories m ON m.id = w.supersedes AND m.valid_to IS NULL WHERE w.supersedes IS NULL OR m.id IS NOT NULL),
    every AS (SELECT user_id, embedding FROM memories WHERE valid_to IS NULL AND mem_type = 'semantic' AND id NOT IN (SELECT supersedes FROM good WHERE supersedes IS NOT NULL) UNION ALL SELECT user_id, embedding FROM good WHERE semantic),
    means AS (SELECT user_id, list(x ORDER BY place) AS mean FROM (SELECT user_id, place, avg(x) AS x FROM (SELECT user_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM every) GROUP BY 1, 2) GROUP BY 1)"""


@query(f"{FOLDED} SELECT user_id, list_transform(mean, lambda x: round(x / sqrt(list_inner_product(mean, mean)), 6)) AS profile FROM means")
def profile_folded(s, d):
    """Profiles from stored sums and what a batch of writes changes; the memories after it are not read."""
    m = memories(s, d)
    said = writes(s, d).withColumns({"mem_type": F.when(F.col("id") % 3 == 1, "semantic").otherwise("episodic"), "embedding": F.reverse("embedding")})
    stored = checkpointed(memory.profile_sums(m))
    out = memory.profiles(memory.merged_sums(stored, memory.profile_changes(m, said)))
    return out.select("user_id", F.transform("profile", lambda x: F.round(x, 6)).alias("profile"))


@query(
    f"""WITH {MEM}, live AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM memories WHERE valid_to IS NULL AND mem_type = 'episodic'), threes AS (SELECT user_id, (n - 1) // 3 AS c, list(id ORDER BY id) AS members FROM live GROUP BY 1, 2 HAVING count(*) = 3),
    facts AS (SELECT user_id, members[1] AS cluster, members FROM threes), closed AS (SELECT unnest(members[1:2]) AS id, cluster + 1000000000 AS heir FROM facts)
    SELECT m.id, m.mem_type, CASE WHEN c.id IS NULL THEN m.valid_to ELSE TIMESTAMP '2024-06-01' END AS valid_to, c.heir AS superseded_by, m.confidence FROM memories m LEFT JOIN closed c USING (id)
    UNION ALL SELECT cluster + 1000000000, 'semantic', NULL, NULL, CASE WHEN cluster % 2 = 0 THEN 1.0 ELSE 0.5 END FROM facts"""
)
def memory_consolidated(s, d):
    """Three live episodic memories at a time are a cluster; its fact replaces two of them, and others that aren't members, which stay."""
    m = memories(s, d)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("id"))
    live = m.where("valid_to is null and mem_type = 'episodic'").select("user_id", "id", F.floor((n - 1) / 3).alias("c"))
    found = live.groupBy("user_id", "c").agg(F.array_sort(F.collect_list("id")).alias("members")).where("size(members) = 3")
    found = found.select("user_id", F.get("members", F.lit(0)).alias("cluster"), "members", F.array(F.lit("all")).alias("entities"))
    sure = F.when(F.col("cluster") % 2 == 0, "7").otherwise("no number")
    strays = F.array_append(F.concat(F.slice("members", 1, 2), F.slice("members", 1, 1)), F.get("members", F.lit(2)) + 1)
    facts = found.select((F.col("cluster") + 1_000_000_000).alias("id"), "cluster", F.lit("learned").alias("content"), sure.alias("confidence"), strays.alias("supersedes"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    blank = facts.withColumns({"id": F.col("id") + 1, "content": F.lit(" ")})
    after = memory.stored_after(m, memory.consolidating(facts.union(blank), found, F.lit(NOW)))
    return after.select("id", "mem_type", "valid_to", "superseded_by", "confidence")


CHAINS = f"""WITH {MEM}, chains AS (SELECT id AS root, id % 5 + 1 AS n, id % 4 AS kind, id % 4 > 1 OR (id % 4 = 0 AND valid_to IS NULL) AS ok FROM memories), links AS (SELECT *, unnest(range(1, n + 1)) AS k FROM chains),
    stored AS (SELECT m.id, CASE WHEN m.valid_to IS NULL AND c.kind = 0 THEN TIMESTAMP '2024-06-01 00:01:00' ELSE m.valid_to END AS valid_to, CASE WHEN m.valid_to IS NULL AND c.kind = 0 THEN 1000000001 + m.id * 10 END AS superseded_by FROM memories m JOIN chains c ON c.root = m.id
        UNION ALL SELECT 1000000000 + root * 10 + k, CASE WHEN k < n THEN TIMESTAMP '2024-06-01' + to_minutes(k + 1) END, CASE WHEN k < n THEN 1000000001 + root * 10 + k END FROM links WHERE ok)"""


def chains(s, d):
    """One batch in which each memory is followed by one to five writes that supersede one another, the first of them the memory, one that there isn't, or none."""
    root, k = F.col("root"), F.col("k")
    m = memories(s, d).select(F.col("id").alias("root"), "user_id", "content", "embedding", F.explode(F.sequence(F.lit(1), (F.col("id") % 5 + 1).cast("int"))).alias("k"))
    before = F.when(k > 1, 999_999_999 + root * 10 + k).when(root % 4 == 0, root).when(root % 4 == 1, -root - 1)
    said = m.select(
        (1_000_000_000 + root * 10 + k).alias("id"), "user_id", F.lit("s9").alias("session_id"), F.col("content").alias("statement"), F.lit(None).cast("string").alias("mem_type"), F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("array<string>").alias("entities"), "embedding", before.alias("supersedes"), (F.lit(NOW) + F.make_dt_interval(F.lit(0), F.lit(0), k)).alias("at"),
    )
    return memory.recorded(said)


@query(f"{CHAINS} SELECT id, valid_to, superseded_by FROM stored")
def memory_chains(s, d):
    return memory.stored_after(memories(s, d), chains(s, d)).select("id", "valid_to", "superseded_by")


@query(f"{CHAINS} SELECT id, valid_to, superseded_by FROM stored")
def memory_replayed(s, d):
    """The same batch twice."""
    once = checkpointed(memory.stored_after(memories(s, d), chains(s, d)))
    return memory.stored_after(once, chains(s, d)).select("id", "valid_to", "superseded_by")


@query(f"{CHAINS} SELECT 1000000000 + root * 10 + k AS id, 'no live memory ' || CASE WHEN k > 1 THEN 999999999 + root * 10 + k WHEN kind = 0 THEN root ELSE -root - 1 END AS error FROM links WHERE NOT ok")
def memory_chains_refused(s, d):
    return memory.refused(memories(s, d), chains(s, d))


@query(f"{CHAINS} SELECT op, count(*) AS n, count(DISTINCT memory_id) AS memories FROM (SELECT 'create' AS op, root * 10 + k AS memory_id FROM links WHERE ok UNION ALL SELECT 'supersede', CASE WHEN k = 1 THEN -root ELSE root * 10 + k END FROM links WHERE ok AND (k > 1 OR kind = 0)) GROUP BY op")
def memory_chains_audit(s, d):
    return memory.write_audit(memories(s, d), chains(s, d)).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("memory_id").alias("memories"))


@query(f"""WITH {MEM}, pairs AS (SELECT id, lead(id) OVER (PARTITION BY user_id ORDER BY id) AS heir, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM memories WHERE valid_to IS NULL), closed AS (SELECT id, heir FROM pairs WHERE n % 2 = 1 AND heir IS NOT NULL)
    SELECT m.id, CASE WHEN c.id IS NULL THEN m.valid_to ELSE TIMESTAMP '2024-06-01' END AS valid_to, c.heir AS superseded_by FROM memories m LEFT JOIN closed c USING (id)""")
def memory_superseded(s, d):
    """Of each two live memories of a user the later one closes the earlier one; closing it again, or what isn't there, is refused."""
    m = memories(s, d)
    mine = Window.partitionBy("user_id").orderBy("id")
    live = m.where("valid_to is null").select("id", "user_id", F.lead("id").over(mine).alias("by"), F.row_number().over(mine).alias("n"))
    odd = live.where("n % 2 = 1 and by is not null")
    rows = odd.select(F.col("by").alias("id"), F.col("id").alias("supersedes"), F.lit(0).alias("seq"))
    again = odd.select(F.col("by").alias("id"), F.col("id").alias("supersedes"), F.lit(1).alias("seq")).union(odd.select("by", -F.col("id") - 1, F.lit(2)))
    kinds = {f.name: f.dataType for f in m.schema}
    nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in ("user_id", "mem_type", "content", "entities", "confidence", "created_by", "source_session_id", "source_ids", "embedding")]
    events = rows.union(again).select("id", *nothing, "supersedes", F.lit(NOW).alias("at"), "seq", F.lit("supersede").alias("op"))
    return memory.stored_after(m, events).select("id", "valid_to", "superseded_by")


AUDIT = f"""WITH {MEM}, {WRITES}, audit AS (SELECT id AS memory_id, revision, 'create' AS op, NULL AS before, {PAYLOAD} AS after FROM good
    UNION ALL SELECT g.old, g.old_revision, 'supersede', m.payload, g.payload FROM (SELECT *, {PAYLOAD} AS payload FROM good) g JOIN (SELECT *, {PAYLOAD} AS payload FROM memories) m ON m.id = g.old)"""


@query(f"{AUDIT} SELECT memory_id, revision::BIGINT AS revision, op, before, after FROM audit")
def memory_audit(s, d):
    rows = memory.write_audit(memories(s, d), writes(s, d))
    return rows.select("memory_id", F.col("revision").cast("long").alias("revision"), "op", "before", "after")


@query(f"{AUDIT} SELECT op, after FROM audit WHERE memory_id = 8")
def memory_audit_view(s, d):
    return memory.audit_view(memory.write_audit(memories(s, d), writes(s, d)), 8).select("op", "after")


@query(f"""WITH {MEM} SELECT id, '{{"id":' || id || ',"revision":1,"mem_type":"' || mem_type || '","content":"' || content || '","entities":["e' || split_part(content, ' ', 4) || '","all"],"confidence":' || confidence || ',"effective_confidence":' || round({CONF}, 3) || ',"created_by":"agent"}}' AS view FROM memories WHERE valid_to IS NULL""")
def memory_json(s, d):
    return memory.live(memories(s, d)).select("id", memory.json_view(F.lit(NOW)).alias("view"))


def copied(s, d):
    """The memories, and three near copies of each episodic one: bent a little, by one component each."""
    m = memories(s, d)
    k = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")
    bent = F.transform("embedding", lambda x, i: x + F.when(i == F.col("k"), 0.02).otherwise(0.0).cast("float"))
    near = m.where("mem_type = 'episodic'").select("*", k).withColumns({"embedding": bent, "id": F.col("id") + F.col("k").cast("long") * 1_000_000_000})
    return m.unionByName(near.drop("k"))


@query(
    f"""WITH {MEM} SELECT user_id, id AS cluster, [id, id + 1000000000, id + 2000000000, id + 3000000000] AS members, ['all', 'e' || split_part(content, ' ', 4)] AS entities FROM memories
    WHERE valid_to IS NULL AND mem_type = 'episodic'"""
)
def memory_clusters(s, d):
    return memory.clusters(copied(s, d))


VALUE = "list_extract(['0.7', '1.5', '-2', 'x', '0.2'], (event_id % 5 + 1)::INT)"


def value():
    return F.get(F.array(*map(F.lit, ("0.7", "1.5", "-2", "x", "0.2"))), (F.col("event_id") % 5).cast("int"))


@query(f"SELECT event_id, CASE WHEN try_cast({VALUE} AS DOUBLE) IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, try_cast({VALUE} AS DOUBLE))) END::DOUBLE AS confidence FROM events")
def clamp(s, d):
    return read(s, d, "events").select("event_id", memory.clamped(value()).alias("confidence"))


@query(f"SELECT event_id, coalesce(try_cast({VALUE} AS DOUBLE) BETWEEN 0.5 AND 1.0, false) AND event_id % 3 <> 0 AS ok FROM events")
def admissible(s, d):
    statement = F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.col("event_type"))
    return read(s, d, "events").select("event_id", memory.admissible(statement, value()).alias("ok"))


@query(f"SELECT count(*) AS considered, count(*) FILTER (ok) AS written, count(*) FILTER (NOT ok) AS discarded FROM (SELECT coalesce(try_cast({VALUE} AS DOUBLE) BETWEEN 0.5 AND 1.0, false) AS ok FROM events)")
def extraction_report(s, d):
    return memory.extraction_counts(read(s, d, "events").select(F.col("event_type").alias("statement"), value().alias("confidence")))


@query("SELECT user_id, event_id, turn > 0 AND (turn + 1) % 10 = 0 AS due FROM (SELECT *, event_id % 31 AS turn FROM events)")
def should_extract(s, d):
    return read(s, d, "events").select("user_id", "event_id", memory.due_for_extraction(F.col("event_id") % 31).alias("due"))


# --- index maintenance --------------------------------------------------------

DELTA = """new AS (SELECT doc_id AS id, source, CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END AS content FROM documents WHERE doc_id % 10 <> 0),
    old AS (SELECT doc_id AS id, text AS content FROM documents WHERE doc_id % 10 <> 2),
    delta AS (SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' WHEN sha256(n.content) = sha256(o.content) THEN 'skip' ELSE 'update' END AS action
    FROM new n FULL JOIN old o ON n.id = o.id)"""


def delta_sides(s, d):
    docs = read(s, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"))
    new = docs.where("id % 10 <> 0").withColumn("content", F.when(F.col("id") % 10 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    sha = F.sha2("content", 256).alias("content_sha")
    return new.select("*", sha), docs.where("id % 10 <> 2").select("*", sha)


@query(f"WITH {DELTA} SELECT id, action FROM delta")
def delta_sync(s, d):
    return sync.delta(*delta_sides(s, d))


def stored_sides(s, d):
    """A new index with the old side, and the candidates of a first and of a second, small delta."""
    new, old = delta_sides(s, d)
    path = new_path(s, "index")
    sync.applied(path, old, embedded)
    late = new.where("id % 200 <> 7").withColumn("content", F.when(F.col("id") % 200 == 9, F.lit("again")).otherwise(F.col("content")))
    return path, new, late.withColumn("content_sha", F.sha2("content", 256))


def embedded(rows):
    """Stands for a model: the length of a text is its vector."""
    return rows.withColumn("embedding", F.array(F.length("content").cast("double")))


LATE = "late AS (SELECT id, CASE WHEN id % 200 = 9 THEN 'again' ELSE content END AS content FROM new WHERE id % 200 <> 7)"
NEW_SIDE = "new AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END AS content FROM documents WHERE doc_id % 10 <> 0)"


@query(f"WITH {NEW_SIDE}, {LATE} SELECT id, sha256(content) AS content_sha, length(content)::DOUBLE AS vector FROM late")
def delta_applied(s, d):
    """What is stored after two deltas, of which the second is applied twice."""
    path, new, late = stored_sides(s, d)
    for side in (new, late, late):
        sync.applied(path, side, embedded)
    return s.read.parquet(path).select("id", "content_sha", F.get("embedding", F.lit(0)).alias("vector"))


@query(
    f"""WITH {NEW_SIDE}, {LATE}, d AS (SELECT new.id, late.id IS NULL AS gone FROM new LEFT JOIN late USING (id) WHERE late.id IS NULL OR late.content <> new.content)
    SELECT (('0x' || left(md5(id::VARCHAR), 7))::BIGINT % 64)::INT AS part, 0 AS inserted, count(*) FILTER (NOT gone) AS updated, count(*) FILTER (gone) AS deleted FROM d GROUP BY 1"""
)
def delta_rewritten(s, d):
    """The parts that a small delta writes again: those with a change, and no other."""
    path, new, late = stored_sides(s, d)
    sync.applied(path, new, embedded)
    return sync.applied(path, late, embedded)


@query("SELECT source AS id FROM documents GROUP BY source HAVING count(DISTINCT sha256(text)) > 1")
def delta_conflicts(s, d):
    return sync.conflicts(read(s, d, "documents").select(F.col("source").alias("id"), F.sha2("text", 256).alias("content_sha")))


@query(f"WITH {DELTA} SELECT 'action:' || action AS key, count(*) AS n FROM delta GROUP BY 1 UNION ALL SELECT 'source:' || source, count(*) FROM new GROUP BY 1")
def delta_stats(s, d):
    new, old = delta_sides(s, d)
    return sync.delta_stats(sync.delta(new, old), new)


@query(
    """WITH a AS (SELECT vec_id AS name, CASE WHEN vec_id % 4 = 1 THEN 'new' ELSE 'old' END AS t FROM embeddings WHERE vec_id % 4 <> 2), b AS (SELECT vec_id AS name, 'old' AS t FROM embeddings WHERE vec_id % 4 <> 3)
    SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'orphaned' ELSE 'changed' END AS drift FROM a FULL JOIN b ON a.name = b.name
    WHERE a.name IS NULL OR b.name IS NULL OR a.t <> b.t"""
)
def catalog_drift(s, d):
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("name"))
    old = e.where("name % 4 <> 3").withColumn("embedding_text", F.lit("old"))
    return sync.drift(e.where("name % 4 <> 2").withColumn("embedding_text", F.when(F.col("name") % 4 == 1, "new").otherwise("old")), old)


# --- turns and metrics ----------------------------------------------------------

LISTS = "SELECT l_orderkey AS qid, list(l_suppkey % 40 ORDER BY l_linenumber, l_suppkey) AS found, list_distinct(list(l_partkey % 40)) AS gold FROM lineitem GROUP BY 1"


def lists(s, d):
    rows = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid"))
    found = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"] % 40)
    return rows.agg(found.alias("found"), F.collect_set(F.col("l_partkey") % 40).alias("gold"))


HITS = "len(list_intersect(list_distinct(found), gold))"


@query(f"SELECT qid, round({HITS} * 2.0::DOUBLE / (len(list_distinct(found)) + len(gold)), 9) AS f1 FROM ({LISTS})")
def set_f1(s, d):
    return lists(s, d).select("qid", F.round(metrics.set_f1(F.col("found"), F.col("gold")), 9).alias("f1"))


@query(f"SELECT qid, round(len(list_intersect(list_distinct(found[1:5]), gold)) / len(gold)::DOUBLE, 9) AS recall FROM ({LISTS})")
def recall_at_5(s, d):
    return lists(s, d).select("qid", F.round(metrics.recall_at(F.col("found"), F.col("gold"), 5), 9).alias("recall"))


@query(
    f"""SELECT qid, round(coalesce(1.0::DOUBLE / list_min(list_filter(range(1, 11), lambda i: i <= len(found) AND list_contains(gold, found[i]))), 0), 9) AS mrr FROM ({LISTS})"""
)
def mrr_at_10(s, d):
    return lists(s, d).select("qid", F.round(metrics.mrr_at(F.col("found"), F.col("gold"), 10), 9).alias("mrr"))


@query(f"SELECT qid, round({HITS} / len(list_distinct(list_concat(found, gold)))::DOUBLE, 9) AS jaccard FROM ({LISTS})")
def tool_jaccard(s, d):
    return lists(s, d).select("qid", F.round(metrics.jaccard(F.col("found"), F.col("gold")), 9).alias("jaccard"))


SCORED = f"(SELECT qid, qid % 6 AS class, {HITS} * 2.0::DOUBLE / (len(list_distinct(found)) + len(gold)) AS f1, len(list_intersect(list_distinct(found[1:5]), gold)) / len(gold)::DOUBLE AS recall, CASE WHEN qid % 2 = 0 THEN 1.0::DOUBLE END AS rate FROM ({LISTS}))"


def scored(s, d):
    f, g = F.col("found"), F.col("gold")
    return lists(s, d).select(
        "qid", (F.col("qid") % 6).alias("class"), metrics.set_f1(f, g).alias("f1"), metrics.recall_at(f, g, 5).alias("recall"), metrics.mrr_at(f, g, 10).alias("mrr"), F.when(F.col("qid") % 2 == 0, 1.0).alias("rate")
    )


@query(f"SELECT round(avg(f1), 6) AS f1, round(avg(recall), 6) AS recall, coalesce(avg(rate), 0) AS rate FROM {SCORED}")
def aggregate_metrics(s, d):
    return rounded(metrics.means(scored(s, d), ["f1", "recall", "rate"]), "f1", "recall")


@query(f"SELECT class, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(recall), 6) AS recall FROM {SCORED} GROUP BY class")
def metrics_by_class(s, d):
    return rounded(metrics.means(scored(s, d), ["f1", "recall"], "class"), "f1", "recall")


@query("SELECT s[len(s) // 2 + 1] AS p50, s[floor(0.95 * (len(s) - 1))::BIGINT + 1] AS p95 FROM (SELECT list_sort(list(l_extendedprice)) AS s FROM lineitem)")
def latency_percentiles(s, d):
    return metrics.latency_percentiles(read(s, d, "lineitem").select(F.col("l_extendedprice").alias("ms")))


@query(
    f"""SELECT qid FROM (SELECT qid, len(list_intersect(list_distinct(found[1:5]), gold)) / len(gold)::DOUBLE AS recall,
    coalesce(1.0::DOUBLE / list_min(list_filter(range(1, 11), lambda i: i <= len(found) AND list_contains(gold, found[i]))), 0) AS mrr FROM ({LISTS})) ORDER BY recall, mrr, qid LIMIT 5"""
)
def weakest(s, d):
    return metrics.weakest(scored(s, d)).select("qid")


@query(
    """WITH m AS (SELECT l_suppkey AS k, round(avg(l_discount), 9) AS value, round(avg(l_tax), 9) AS base FROM lineitem GROUP BY 1), known AS (SELECT *, k % 7 > 0 AS has FROM m)
    SELECT 'm' || k AS metric, CASE WHEN k % 3 < 2 THEN CASE WHEN has THEN value < base - (k % 10) / 1000.0::DOUBLE ELSE true END END AS failed FROM known"""
)
def baseline_gate(s, d):
    """A metric for each supplier; some have no value any more, and a third are only reported."""
    k = F.col("l_suppkey")
    m = read(s, d, "lineitem").groupBy(k).agg(F.round(F.avg("l_discount"), 9).alias("value"), F.round(F.avg("l_tax"), 9).alias("base")).withColumn("metric", F.concat(F.lit("m"), k.cast("string")))
    tolerances = m.where(k % 3 < 2).select("metric", (k % 10 / 1000.0).alias("tolerance"))
    return metrics.gate(m.where(k % 7 > 0).select("metric", "value"), m.select("metric", "base"), tolerances)


@query(
    """WITH f AS (SELECT DISTINCT l_orderkey AS qid, l_suppkey % 40 AS item FROM lineitem), g AS (SELECT DISTINCT l_orderkey AS qid, l_partkey % 40 AS item FROM lineitem)
    SELECT qid, item, '+' AS sign FROM (SELECT * FROM f EXCEPT SELECT * FROM g) UNION ALL SELECT qid, item, '-' FROM (SELECT * FROM g EXCEPT SELECT * FROM f)"""
)
def explain_diff(s, d):
    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_suppkey") % 40).alias("item"), (F.col("l_partkey") % 40).alias("gold"))
    return metrics.explained(rows.select("qid", "item"), rows.select("qid", F.col("gold").alias("item")))


@query("SELECT event_id, round((event_id * 5.0::DOUBLE + user_id * 25.0::DOUBLE + (event_id % 7) * 1.0::DOUBLE) / 1000000::DOUBLE, 6) AS cost FROM events")
def turn_cost(s, d):
    rows = read(s, d, "events").select("event_id", F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"), (F.col("event_id") % 7 * 2).alias("cache_read"), F.lit(None).cast("long").alias("cache_write"))
    return rows.select("event_id", turns.cost().alias("cost"))


@query("SELECT DISTINCT user_id AS turn, 'pr:' || (event_id % 50) AS citation, false AS is_span FROM events WHERE event_type NOT IN ('error', 'signup')")
def turn_results(s, d):
    raw = F.concat(F.lit("pr:"), (F.col("event_id") % 50).cast("string"))
    tool = F.when(F.col("event_type") == "signup", "memory_search").otherwise(F.col("event_type"))
    calls = read(s, d, "events").select(F.col("user_id").alias("turn"), tool.alias("tool"), (F.col("event_type") == "error").alias("is_error"), F.array(F.struct(raw.alias("raw"), F.lit("pr").alias("kind"))).alias("citations"))
    return turns.turn_results(calls)


CHECKS = """(SELECT DISTINCT user_id AS turn, 'pr:' || (event_id % 50) AS citation, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = e.event_id % 50) AS resolved,
    EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'view' AND r.event_id % 50 = e.event_id % 50) AS in_result_set FROM events e)"""


def checks(s, d):
    c = read(s, d, "events").select(F.col("user_id").alias("turn"), F.concat(F.lit("pr:"), (F.col("event_id") % 50).cast("string")).alias("citation"), "event_type")
    known = read(s, d, "orders").where("o_orderkey < 50").select(F.concat(F.lit("pr:"), F.col("o_orderkey").cast("string")).alias("citation"))
    return turns.citation_checks(c, known, c.where("event_type = 'view'"))


@query(f"SELECT * FROM {CHECKS}")
def citation_resolution(s, d):
    return checks(s, d)


@query(f"SELECT turn, round(avg((resolved AND in_result_set)::INT), 6) AS rate FROM {CHECKS} GROUP BY turn")
def citation_rate(s, d):
    return rounded(metrics.citation_rate(checks(s, d), "turn"), "rate")


@query(
    """WITH firsts AS (SELECT user_id AS qid, event_id % 20 AS entity, min(event_id) AS "at" FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)
    SELECT qid, list(entity ORDER BY "at") AS entities FROM firsts GROUP BY qid"""
)
def gold_tool_entities(s, d):
    e = read(s, d, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("tool"), F.col("event_id").alias("seq"), F.array(F.col("event_id") % 20).alias("entities"))
    return turns.gold_tool_entities(e, e.where(F.col("tool").isin("click", "view")))


@query(
    """WITH e AS (SELECT user_id AS turn, event_id AS seq, event_type AS tool, event_id % 7 AS k, event_id % 3 AS m, event_id % 9 AS n, value FROM events)
    SELECT turn, max_by('s' || m, seq) FILTER (k = 0) AS session_id, coalesce(list(tool ORDER BY seq) FILTER (k = 1 AND tool <> 'error'), []) AS tools, coalesce(list('area' || n ORDER BY seq) FILTER (k = 2 AND m = 1 AND n > 3), []) AS areas,
    coalesce(list(['a', 'b' || n] ORDER BY seq) FILTER (k = 2 AND m = 1 AND n < 7), []) AS windows, coalesce(max_by(n, seq) FILTER (k = 3), 0)::BIGINT AS memories, count(*) FILTER (k = 4) AS writes,
    round(coalesce(max_by(value, seq) FILTER (k = 5), 0), 6) AS cost, coalesce(max_by(n * 100, seq) FILTER (k = 5), 0)::BIGINT AS latency_ms, coalesce(bool_or(k = 6), false) AS error FROM e GROUP BY turn"""
)
def turn_record(s, d):
    """Each user's events as those of a turn, of all kinds."""
    i, t = F.col("event_id"), F.col("event_type")
    kinds = ("session", "tool_call", "retrieval", "memory_loaded", "memory_write", "done", "error")
    n = i % 9
    rows = read(s, d, "events").select(
        F.col("user_id").alias("turn"), i.alias("seq"), F.get(F.array(*map(F.lit, kinds)), (i % 7).cast("int")).alias("event"), F.when(t == "error", "failed").otherwise("ok").alias("status"), t.alias("tool"),
        F.when(i % 3 == 1, "structured").otherwise("semantic").alias("kind"), F.when(n > 3, F.concat(F.lit("area"), n.cast("string"))).alias("area"), F.when(n < 7, F.array(F.lit("a"), F.concat(F.lit("b"), n.cast("string")))).alias("window"),
        n.alias("n"), F.col("value").alias("cost"), (n * 100).alias("latency_ms"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("session_id"),
    )
    return turns.turn_record(rows)


@query("SELECT user_id AS scenario, min(event_id % 5) FILTER (event_type = 'view' AND event_id % 5 <= 3) AS turns FROM events GROUP BY 1")
def scenario_turns(s, d):
    e = read(s, d, "events")
    records = e.select(F.col("user_id").alias("scenario"), (F.col("event_id") % 5).alias("turn"), F.array("event_type").alias("tools"), F.array().cast("array<string>").alias("areas"))
    want = e.select(F.col("user_id").alias("scenario"), F.lit("view").alias("want_tool"), F.lit(None).cast("string").alias("want_area")).distinct()
    return turns.scenario_turns(records, want)


@query(
    """SELECT event_type AS arm, round(avg((event_id % 4 < 3)::INT), 6) AS success_rate, round(avg(CASE WHEN event_id % 4 < 3 THEN event_id % 4 + 1 END), 6) AS mean_turns,
    round(sum(value) / count(*) FILTER (event_id % 4 < 3), 6) AS cost_per_success, round(sum(value), 4) AS total_cost FROM events GROUP BY 1"""
)
def arm_report(s, d):
    rows = read(s, d, "events").select(F.col("event_type").alias("arm"), F.when(F.col("event_id") % 4 < 3, F.col("event_id") % 4 + 1).alias("turns"), F.col("value").alias("cost"))
    return rounded(metrics.arm_report(rows), "success_rate", "mean_turns", "cost_per_success").withColumn("total_cost", F.round("total_cost", 4))


@query("SELECT doc_id, floor(length(text) / 3.5::DOUBLE)::BIGINT AS tokens FROM documents")
def prompt_tokens(s, d):
    return read(s, d, "documents").select("doc_id", metrics.prompt_tokens(F.col("text")).alias("tokens"))


@query(
    """WITH v AS (SELECT p_partkey // 50 AS place, min(split_part(p_name, ' ', 1)) || p_partkey // 50 AS word FROM part GROUP BY 1), o AS (SELECT row_number() OVER (ORDER BY w) - 1 AS place, w AS word FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part))
    SELECT v.word || '_' || o.word AS name, (v.place * (SELECT count(*) FROM o) + o.place)::BIGINT AS ordinal FROM v, o ORDER BY ordinal LIMIT 200"""
)
def synthetic_tools(s, d):
    """Verbs and objects from the names of parts."""
    part, batch = read(s, d, "part"), F.floor(F.col("p_partkey") / 50)
    verbs = part.groupBy(batch.alias("place")).agg(F.min(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("w")).select(F.concat("w", F.col("place").cast("string")).alias("word"), "place")
    words = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word")).distinct()
    return metrics.synthetic_tools(verbs, words.withColumn("place", F.row_number().over(Window.orderBy("word")) - 1), 200)


@query(
    f"""WITH p AS (SELECT label = (SELECT label FROM embeddings WHERE vec_id = {PROBE}) AS is_gold, {SIM} AS score FROM embeddings WHERE vec_id <> {PROBE}), m AS (SELECT median(score) FILTER (is_gold) AS gold,
    median(score) FILTER (NOT is_gold) AS other FROM p) SELECT round(gold, 6) AS gold, round(other, 6) AS other, round(gold - other, 6) AS separation, round((SELECT avg((score >= gold)::INT) FROM p WHERE NOT is_gold), 6) AS overlap FROM m"""
)
def separation(s, d):
    e = read(s, d, "embeddings")
    label = e.where(F.col("vec_id") == PROBE).first()["label"]
    pairs = e.where(F.col("vec_id") != PROBE).select((F.col("label") == label).alias("is_gold"), retrieval.cosine(F.col("embedding"), probe(s, d)).alias("score"))
    return rounded(metrics.separation(pairs), "gold", "other", "separation", "overlap")

