"""The queries op1_ to op13_, over the given tables as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relayscope.llm import chat, exact_dedup, lines, merkle, minhash, mixing, packing, pii, runs, substrings, token_counts, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet"), key="a key that the caller keeps")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.rendered(chat.folded(streamed(rows))))


def streamed(rows: DataFrame) -> DataFrame:
    """The messages of ``rows`` (conv_id, turn, role, text) as the log of a service that streams and corrects them.

    Each row is a turn. Its text comes in three deltas; every third turn is at
    first a draft that an edit replaces, and every fourth is answered wrongly,
    with a turn after it, before it is regenerated. Later events come first.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    turns = rows.withColumn("place", place).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("part", F.floor(F.length("text") / 3).cast("int") + 1)

    def event(at: int, op: str, text: Column, role: Column | None = None, turn: Column | None = None, when: Column | None = None) -> Column:
        made = F.struct(
            (F.col("place") * 20 + at).alias("seq"), (F.col("place") if turn is None else turn).alias("turn"), F.lit(op).alias("op"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text")
        )
        return made if when is None else F.when(when, made)

    chunk = lambda k: F.substr("text", F.col("part") * k + 1, F.col("part"))
    draft, wrong = F.col("place") % 3 == 0, F.col("place") % 4 == 0
    nothing, role = F.lit(""), F.col("role")
    log = [
        event(0, "message", nothing, F.lit("draft"), when=wrong),
        event(1, "delta", F.lit("a wrong answer, <turn:cut off"), when=wrong),
        event(2, "message", F.lit("on the wrong answer"), F.lit("user"), F.col("place") + 1, wrong),
        event(3, "regenerate", nothing, role, when=wrong),
        event(4, "message", F.when(draft, F.lit("a draft ")).otherwise(nothing), role, when=~wrong),
        *(event(5 + k, "delta", chunk(k)) for k in range(3)),
        event(9, "edit", F.col("text"), role, when=draft),
    ]
    events = turns.select("conv_id", F.explode(F.reverse(F.filter(F.array(*log), lambda e: e.isNotNull()))).alias("e"))
    return events.select("conv_id", "e.*")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.near_duplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Of the tokens, by the labels' quality.
SHARES = {0: 0.1, 1: 0.9}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_rates(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), SHARES)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(runs.with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered, merkle.lowered(F.col("text")))


OPERATORS = (
    op1_minhash,
    op2_pii,
    op3_toxicity,
    op4_chat_formatting,
    op5_line_dedup,
    op6_exact_topk,
    op7_exact_dedup,
    op8_mixing,
    op9_suffix_array_dedup,
    op10_best_fit_packing,
    op11_periodic_runs,
    op12_token_counts,
    op13_merkle_manifest,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_formatting": r"""
            WITH turns AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
            ), sizes AS (
                SELECT *, length(role || text) + length(regexp_replace(role || text, '[^<\\]', '', 'g')) + 20 AS size FROM turns
            )
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum(size)::BIGINT AS formatted_chars
            FROM sizes GROUP BY conv_id""",
        "op6_exact_topk": """
            WITH whole AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), scores AS (
                SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
                FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
            ), ranked AS (
                SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores
            )
            SELECT * FROM ranked WHERE rank <= 5""",
        "op7_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
        "op13_merkle_manifest": r"""
            WITH RECURSIVE crc AS (
                -- The 256 remainders of CRC-32, by eight steps each.
                SELECT list(r ORDER BY b) AS t FROM (
                    SELECT b, list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r
                    FROM (SELECT unnest(range(256)) AS b))
            ), rows AS (
                SELECT doc_id, source, lang, n_chars, text,
                       coalesce(xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                                lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0, false) AS tampered
                FROM documents, crc
            ), fields AS (
                SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                          || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS others,
                       CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown
                FROM rows
            ), leaves AS (
                SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256(others || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                       sha256(others || coalesce(octet_length(encode(shown)) || ':' || shown, '-')) AS shown_leaf
                FROM fields
            ), placed AS (
                SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves
            ), low AS (
                SELECT tree, 0 AS level, place, n, leaf AS h FROM placed
                UNION ALL
                SELECT tree, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY ALL
            ), subroots AS (
                SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS top_place, count(*) OVER () AS n FROM low WHERE n = 1
            ), high AS (
                SELECT 0 AS level, top_place AS place, n, h FROM subroots
                UNION ALL
                SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY ALL
            ), runs AS (
                SELECT tree, level, place // 16 AS run, list(h ORDER BY place) AS members FROM low WHERE n > 1 GROUP BY ALL
                UNION ALL SELECT NULL, level, place // 16, list(h ORDER BY place) FROM high WHERE n > 1 GROUP BY ALL
            ), ways AS (
                SELECT p.doc_id, p.leaf, p.tree, p.place, r.level, p.shown_leaf, 0 AS part, r.members, (p.place // (16 ** r.level)::BIGINT) % 16 AS slot
                FROM placed p JOIN runs r ON r.tree = p.tree AND r.run = p.place // (16 ** (r.level + 1))::BIGINT
                UNION ALL
                SELECT p.doc_id, p.leaf, p.tree, p.place, r.level, p.shown_leaf, 1, r.members, (s.top_place // (16 ** r.level)::BIGINT) % 16
                FROM placed p JOIN subroots s USING (tree) JOIN runs r ON r.tree IS NULL AND r.run = s.top_place // (16 ** (r.level + 1))::BIGINT
            ), steps AS (
                SELECT *, array_to_string(members[:slot], '') AS a, array_to_string(members[slot + 2:], '') AS b FROM ways
            ), paths AS (
                SELECT tree, place, sha256(string_agg(a || b, '' ORDER BY part, level)) AS proof, list([a, b] ORDER BY part, level) AS path FROM steps GROUP BY ALL
            )
            SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, coalesce(w.proof, sha256('')) AS proof_sha256,
                   list_reduce([[p.shown_leaf]] || coalesce(w.path, []), lambda x, y: [sha256(y[1] || x[1] || y[2])])[1] AS folded_root, folded_root = t.h AS verified
            FROM placed p JOIN subroots s USING (tree) LEFT JOIN paths w USING (tree, place), (SELECT h FROM high WHERE n = 1) t""",
    }
