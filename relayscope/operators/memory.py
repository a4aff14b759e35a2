"""A versioned memory: rows are only appended, and what holds now is derived."""

from __future__ import annotations

import math
from datetime import datetime
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayscope.functions.text import estimated_tokens
from relayscope.operators.lineage import checkpointed
from relayscope.operators.retrieval import cosine, dot

# Half-lives in days by type (what is procedural doesn't grow old), and that of confidence.
HALF_LIFE = {"semantic": 180.0, "episodic": 30.0, "procedural": None}
CONFIDENCE_HALF_LIFE = 180.0
SPLIT = {"semantic": 0.5, "episodic": 0.3, "procedural": 0.2}
CANDIDATES = {"semantic": 20, "episodic": 20, "procedural": 5}
CONFIDENCE_FLOOR = 0.3
# Fixed value: what stands before the memories in a prompt.
PREAMBLE = (
    "What you already know about this user and their work, from earlier "
    "sessions. Provenance is shown so you can weigh it: a low-confidence or "
    "old memory is a lead, not a fact. Never restate a status claim from "
    "memory without re-verifying it against the tools — memory records what "
    "was true when it was written, not what is true now."
)
LINKAGE, CLUSTER = 0.35, 3
CREATE, SUPERSEDE, REVERT = "create", "supersede", "revert"


def age_days(valid_from: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(valid_from.cast("timestamp"))) / 86_400_000_000.0


def decay(days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), days / half_life)


def live(memories: DataFrame, mem_type: str | None = None) -> DataFrame:
    """What is valid now, the newest first."""
    rows = memories.where("valid_to is null")
    if mem_type is not None:
        rows = rows.where(F.col("mem_type") == mem_type)
    return rows.orderBy(F.desc("valid_from"), "id")


def ranked(memories: DataFrame, user: Column | int | str, mem_type: str, query: Column, now: Column, k: int, half_life: float | None = None, weighted: bool = False) -> DataFrame:
    """id, score: similarity, halved with each half-life if there is one, and times confidence if weighted; the k best after that."""
    score = cosine(F.col("embedding"), query)
    if half_life is not None:
        score = score * decay(age_days(F.col("valid_from"), now), half_life)
    score = score * F.col("confidence").cast("double") if weighted else score
    rows = memories.where(F.col("valid_to").isNull() & (F.col("user_id") == user) & (F.col("mem_type") == mem_type))
    return rows.select("id", "content", "mem_type", "confidence", "valid_from", "source_session_id", "source_ids", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def effective_confidence(confidence: Column, valid_from: Column, now: Column) -> Column:
    return confidence.cast("double") * decay(F.greatest(age_days(valid_from, now), F.lit(0.0)), CONFIDENCE_HALF_LIFE)


def rendered(now: Column) -> Column:
    """A line with where a memory comes from, and its content."""
    sure = F.format_string("semantic · conf %.1f", effective_confidence(F.col("confidence"), F.col("valid_from"), now))
    n = F.size(F.coalesce("source_ids", F.array().cast("array<string>")))
    sessions = F.when(n == 1, " · from 1 session").when(n > 1, F.format_string(" · from %d sessions", n)).otherwise("")
    session = F.coalesce(F.concat(F.lit(" · "), F.nullif("source_session_id", F.lit(""))), F.lit(""))
    origin = (
        F.when(F.col("mem_type") == "semantic", F.concat(sure, sessions))
        .when(F.col("mem_type") == "episodic", F.concat(F.lit("episodic · "), F.date_format("valid_from", "yyyy-MM-dd"), session))
        .otherwise("procedural")
    )
    return F.concat(F.lit("["), origin, F.lit("] "), F.col("content"))


def packed(rows: DataFrame, budget: int, by: list[str], order: list) -> DataFrame:
    """Rows in rank order until the first that goes over the budget; costs are positive, so a running sum tells."""
    total = F.sum("cost").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("total", total).where(F.col("total") <= budget)


def block(memories: DataFrame, user, query: Column, now: Column, budget: int) -> DataFrame:
    """id, mem_type, place, line of the memories for a prompt, in order.

    Each type has its share of the budget. The semantic ones are ranked by the
    query blended with the user's profile, times confidence, and weak ones go
    after the candidates are chosen; procedural ones don't decay. What then
    exceeds the whole budget with the preamble goes from the end.
    """
    own = profile_vector(memories.where(F.col("user_id") == user)).select(F.col("profile").alias("own_profile"))
    parts = None
    for place, (kind, share) in enumerate(SPLIT.items()):
        semantic = kind == "semantic"
        # A user has one profile or none: at most one row.
        table = memories.join(own, F.lit(True), "left") if semantic else memories
        asked = blended(query, F.col("own_profile")) if semantic else query
        rows = ranked(table, user, kind, asked, now, CANDIDATES[kind], HALF_LIFE[kind], weighted=semantic)
        if semantic:
            rows = rows.where(effective_confidence(F.col("confidence"), F.col("valid_from"), now) >= CONFIDENCE_FLOOR)
        rows = rows.withColumn("line", rendered(now)).withColumn("cost", estimated_tokens(F.col("line"))).withColumn("place", F.lit(place))
        fitting = packed(rows, int(budget * share), ["mem_type"], [F.desc("score"), "id"])
        parts = fitting if parts is None else parts.union(fitting)
    # At most CANDIDATES rows remain, so the last pass is small.
    size = F.sum(F.length("line") + 1).over(Window.orderBy("place", F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0))
    whole = parts.withColumn("size", size)
    return whole.where(F.ceil((F.col("size") + len(PREAMBLE) + 1) / F.lit(3.5).cast("double")) <= budget).select("id", "mem_type", "place", "score", "line")


def block_text(lines: DataFrame) -> DataFrame:
    """text, tokens of the rows of ``block``: the preamble and the lines; nothing for no lines."""
    each = F.array_sort(F.collect_list(F.struct("place", (-F.col("score")).alias("worse"), "id", "line")))
    text = F.concat(F.lit(PREAMBLE + "\n\n"), F.array_join(F.transform(each, lambda x: x["line"]), "\n"))
    whole = lines.agg(F.when(F.count("*") > 0, text).otherwise("").alias("text"))
    return whole.select("text", estimated_tokens(F.col("text")).alias("tokens"))


def profile_vector(memories: DataFrame) -> DataFrame:
    """user_id, profile: the mean of a user's live semantic vectors, of length 1."""
    each = memories.where("valid_to is null and mem_type = 'semantic'").select("user_id", F.posexplode("embedding").alias("place", "x"))
    means = each.groupBy("user_id", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda e: e["x"]).alias("mean"))
    return whole.select("user_id", unit(F.col("mean")).alias("profile"))


def vector_sums(rows: DataFrame, sign: int = 1) -> DataFrame:
    """user_id, place, total, n: what ``rows`` (user_id, embedding) add to their users' sums, or take from them."""
    each = rows.select("user_id", F.posexplode("embedding").alias("place", "x"))
    return each.groupBy("user_id", "place").agg((sign * F.sum(F.col("x").cast("double"))).alias("total"), (sign * F.count("x")).alias("n"))


def profile_sums(memories: DataFrame) -> DataFrame:
    """The sums of all live semantic vectors; kept as a table, they take later events without another pass over the memories."""
    return vector_sums(memories.where("valid_to is null and mem_type = 'semantic'"))


def profile_changes(memories: DataFrame, writes: DataFrame) -> DataFrame:
    """What a batch of events does to the sums: vectors that it writes and leaves live come in, those of memories that it closes go. ``memories`` are those before it."""
    good, _ = judged(memories, writes)
    closed = good.where("supersedes is not null").select(F.col("supersedes").alias("closed_id"))
    fresh = written_rows(memories, good).where("mem_type = 'semantic'")
    stay = fresh.join(closed, F.col("id") == F.col("closed_id"), "left_anti")
    gone = memories.where("valid_to is null and mem_type = 'semantic'").join(closed, F.col("id") == F.col("closed_id"), "left_semi")
    return vector_sums(stay).unionByName(vector_sums(gone, -1))


def merged_sums(*sums: DataFrame) -> DataFrame:
    """Sums of the same users and places together; a user without vectors has none."""
    every = reduce(DataFrame.unionByName, sums)
    return every.groupBy("user_id", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0")


def profiles(sums: DataFrame) -> DataFrame:
    """user_id, profile from the sums: the mean, of length 1."""
    mean = F.transform(F.array_sort(F.collect_list(F.struct("place", (F.col("total") / F.col("n")).alias("x")))), lambda e: e["x"])
    return sums.groupBy("user_id").agg(mean.alias("mean")).select("user_id", unit(F.col("mean")).alias("profile"))


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)))


def blended(query: Column, profile: Column) -> Column:
    """Half the query and half the profile, of length 1; the query alone without a profile."""
    return F.when(profile.isNull(), query).otherwise(unit(F.zip_with(query, profile, lambda a, b: (a + b) / 2)))


def reverted(memories: DataFrame, memory_id, revision: int, now: datetime) -> DataFrame:
    """All rows after a revert: what is live of the memory is closed, and a new last revision has the old content.

    A memory that was superseded comes back to life; its successor stays.
    """
    mine = memories.where(F.col("id") == memory_id)
    top = mine.agg(F.max("revision").alias("top")).first()["top"]
    if top is None:
        raise LookupError(f"no memory {memory_id!r}")
    old = mine.where(F.col("revision") == revision)
    if old.isEmpty():
        raise LookupError(f"memory {memory_id!r} has no revision {revision}")
    at = F.lit(now)
    closed = memories.withColumn("valid_to", F.when((F.col("id") == memory_id) & F.col("valid_to").isNull(), at).otherwise(F.col("valid_to")))
    fresh = old.withColumns({"revision": F.lit(top + 1).cast(memories.schema["revision"].dataType), "valid_from": at, "valid_to": F.lit(None).cast(memories.schema["valid_to"].dataType), "created_by": F.lit("human")})
    return closed.unionByName(fresh)


def superseded(memories: DataFrame, old_id, now: datetime, by=None) -> DataFrame:
    """All rows after a live memory is closed in favour of the memory ``by``; an old_id that isn't live raises."""
    if memories.where((F.col("id") == old_id) & F.col("valid_to").isNull()).isEmpty():
        raise LookupError(f"no live memory {old_id!r}")
    closing = (F.col("id") == old_id) & F.col("valid_to").isNull()
    out = memories.withColumn("valid_to", F.when(closing, F.lit(now)).otherwise(F.col("valid_to")))
    if by is None:
        return out
    kind = memories.schema["superseded_by"].dataType if "superseded_by" in memories.columns else memories.schema["id"].dataType
    before = F.col("superseded_by") if "superseded_by" in memories.columns else F.lit(None).cast(kind)
    closing = (F.col("id") == old_id) & (F.col("valid_to") == F.lit(now)) & before.isNull()
    return out.withColumn("superseded_by", F.when(closing, F.lit(by).cast(kind)).otherwise(before))


def stored_after(memories: DataFrame, writes: DataFrame) -> DataFrame:
    """All rows after ``writes``: an ordered batch of events, by at, then seq if there is one, then id.

    A write (the columns of a memory, at, and supersedes: an id or null) is a new
    memory at revision 1, live from ``at``; the live memory that it supersedes,
    stored or written before in the batch, is closed then, and named its
    successor. An event with op "supersede" closes a live memory in favour of
    ``id``, which is there already. An event whose supersedes isn't live does
    nothing; see ``refused``. Writes that are stored already do nothing either,
    so that a batch may come again.
    """
    good, _ = judged(memories, writes)
    closing = good.where("supersedes is not null").select(F.col("supersedes").alias("closed_id"), F.struct("at", F.col("id").alias("by")).alias("close"))
    columns = [*memories.columns, *(["superseded_by"] if "superseded_by" not in memories.columns else [])]
    before = memories if "superseded_by" in memories.columns else memories.withColumn("superseded_by", F.lit(None).cast(memories.schema["id"].dataType))
    rows = before.select(*columns).unionByName(written_rows(memories, good).select(*columns)).join(closing, F.col("id") == F.col("closed_id"), "left")
    live_row = F.col("valid_to").isNull() & F.col("close").isNotNull()
    changed = {"superseded_by": F.when(live_row, F.col("close.by")).otherwise(F.col("superseded_by")), "valid_to": F.when(live_row, F.col("close.at")).otherwise(F.col("valid_to"))}
    return rows.withColumns(changed).select(*columns)


def written_rows(memories: DataFrame, good: DataFrame) -> DataFrame:
    """The new memories of judged events, before any of them is closed."""
    kinds = memories.schema
    fresh = {"revision": F.lit(1).cast(kinds["revision"].dataType), "valid_from": F.col("at"), "valid_to": F.lit(None).cast(kinds["valid_to"].dataType), "superseded_by": F.lit(None).cast(kinds["id"].dataType)}
    return good.where("op = 'write'").withColumns(fresh)


def judged(memories: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events that can be done, and those that can't, both with op and turn (their order).

    An event needs its memory to be live: stored so, or written before in the
    batch by an event that can be done; and of the events for one memory the
    first has it. Whether that holds up a chain of events is found by pointer
    doubling, in as many rounds as the length of the longest chain has digits.
    """
    events = writes if "op" in writes.columns else writes.withColumn("op", F.lit("write"))
    turn = F.struct("at", *(["seq"] if "seq" in writes.columns else []), "id")
    stored = memories.select(F.col("id").alias("stored_id")).distinct()
    events = checkpointed(events.join(stored, (F.col("op") == "write") & (F.col("id") == F.col("stored_id")), "left_anti").withColumn("turn", turn), "events")
    closers = events.where("supersedes is not null").select("id", "op", "turn", "supersedes")
    alive = memories.where("valid_to is null").select(F.col("id").alias("live_id")).distinct()
    made = events.where("op = 'write'").select(F.col("id").alias("up"), F.col("turn").alias("made_turn"))
    known = closers.join(alive, F.col("supersedes") == F.col("live_id"), "left").join(made, (F.col("supersedes") == F.col("up")) & (F.col("made_turn") < F.col("turn")), "left")
    fits = F.col("live_id").isNotNull() | F.col("up").isNotNull()
    first = known.where(fits).groupBy(F.col("supersedes").alias("for")).agg(F.min("turn").alias("first"))
    marked = known.join(first, F.col("supersedes") == F.col("for"), "left").select("id", "op", "turn", "supersedes", "up", F.coalesce(fits & (F.col("turn") == F.col("first")), F.lit(False)).alias("good"))
    marked = checkpointed(marked, "marked")
    state = marked.where("op = 'write'").select("id", "up", "good")
    while not state.where("up is not null").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("good").alias("above"))
        state = checkpointed(state.join(above, "up", "left").select("id", F.col("next").alias("up"), (F.col("good") & F.coalesce("above", F.lit(True))).alias("good")), "chains")
    makers = state.select(F.col("id").alias("up"), F.col("good").alias("made"))
    verdicts = marked.join(makers, "up", "left").select(F.col("turn").alias("its_turn"), F.col("supersedes").alias("its_target"), (F.col("good") & F.coalesce("made", F.lit(True))).alias("done"))
    told = events.join(verdicts, (F.col("turn") == F.col("its_turn")) & (F.col("supersedes") == F.col("its_target")), "left").withColumn("done", F.coalesce("done", F.lit(True)))
    told = checkpointed(told.drop("its_turn", "its_target"), "told")
    return told.where("done").drop("done"), told.where("not done").drop("done")


def refused(memories: DataFrame, writes: DataFrame) -> DataFrame:
    """id, error of the events that ``stored_after`` doesn't do."""
    return judged(memories, writes)[1].select("id", F.concat(F.lit("no live memory "), F.col("supersedes").cast("string")).alias("error"))


def payload() -> Column:
    """A memory as an audit row has it: JSON without its vector."""
    return F.to_json(F.struct("id", "revision", "user_id", "mem_type", "content", "confidence", "created_by"))


def write_audit(memories: DataFrame, writes: DataFrame) -> DataFrame:
    """memory_id, revision, op, before, after, actor, at: a row for each memory that the events create, and one for each that they close.

    What a write closes shows its successor as after, what another memory closes itself.
    """
    good, _ = judged(memories, writes)
    fresh = written_rows(memories, good)
    made = fresh.select(F.col("id").alias("memory_id"), "revision", F.lit(CREATE).alias("op"), F.lit(None).cast("string").alias("before"), payload().alias("after"), F.col("created_by").alias("actor"), "at")
    old = F.col("id").alias("old_id"), F.col("revision").alias("old_revision"), payload().alias("before")
    olds = memories.where("valid_to is null").select(*old).union(fresh.select(*old))
    successors = fresh.select(F.col("id").alias("new_id"), payload().alias("successor"), F.col("created_by").alias("maker"))
    closed = good.where("supersedes is not null").select("id", "op", "supersedes", "at").join(olds, F.col("supersedes") == F.col("old_id"))
    closed = closed.join(successors, (F.col("op") == "write") & (F.col("id") == F.col("new_id")), "left")
    by_write = F.col("op") == "write"
    rows = closed.select("old_id", "old_revision", F.lit(SUPERSEDE), "before", F.when(by_write, F.col("successor")).otherwise(F.col("before")), F.when(by_write, F.col("maker")).otherwise(F.lit("consolidation")), "at")
    return made.union(rows)


def audit_view(audit: DataFrame, memory_id) -> DataFrame:
    """The audit rows of one memory, the newest first; of one instant, the one of the later operation first."""
    return audit.where(F.col("memory_id") == memory_id).orderBy(F.desc("at"), F.desc("revision"), F.desc("op"))


def recorded(statements: DataFrame, *more: str) -> DataFrame:
    """Writes from what an agent asks to remember (id, user_id, session_id, statement, at, embedding, and mem_type, confidence, entities or supersedes, which may be null): episodic and 0.8 if not told otherwise."""
    return statements.select(
        "id",
        "user_id",
        F.coalesce("mem_type", F.lit("episodic")).alias("mem_type"),
        F.col("statement").alias("content"),
        F.coalesce("entities", F.array().cast("array<string>")).alias("entities"),
        F.coalesce("confidence", F.lit(0.8)).alias("confidence"),
        F.lit("agent").alias("created_by"),
        F.col("session_id").alias("source_session_id"),
        F.array().cast("array<string>").alias("source_ids"),
        "embedding",
        "supersedes",
        "at",
        *more,
    )


def history(memories: DataFrame, memory_id) -> DataFrame:
    """The revisions of a memory, the oldest first; an unknown id raises."""
    rows = memories.where(F.col("id") == memory_id)
    if rows.isEmpty():
        raise LookupError(f"no memory {memory_id!r}")
    return rows.orderBy("revision")


def json_view(now: Column) -> Column:
    """A memory for a client, with its stored and its effective confidence."""
    shown = F.round(effective_confidence(F.col("confidence"), F.col("valid_from"), now), 3)
    return F.to_json(F.struct("id", "revision", "mem_type", "content", "entities", F.round(F.col("confidence").cast("double"), 3).alias("confidence"), shown.alias("effective_confidence"), "created_by"))


def due_for_extraction(turn: Column, every: int = 10) -> Column:
    """After every tenth turn that is done; turns count from 0."""
    return (turn > 0) & ((turn + 1) % every == 0)


def extraction_counts(facts: DataFrame) -> DataFrame:
    """considered, written, discarded of extracted facts (statement, confidence)."""
    good = F.coalesce(F.count_if(admissible(F.col("statement"), F.col("confidence"))), F.lit(0))
    return facts.agg(F.count("*").alias("considered"), good.alias("written"), (F.count("*") - good).alias("discarded"))


def clamped(value: Column) -> Column:
    """A confidence between 0 and 1; 0.5 for what is no number."""
    number = value.try_cast("double")
    return F.when(number.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def admissible(statement: Column, confidence: Column) -> Column:
    return F.coalesce((F.trim(statement) != "") & confidence.try_cast("double").between(0.5, 1.0), F.lit(False))


def average_linkage(vectors: np.ndarray, most: float = LINKAGE) -> np.ndarray:
    """Clusters by average linkage of cosine distances, merging while the nearest two are under ``most`` apart."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    far = 1 - v @ v.T
    np.fill_diagonal(far, np.inf)
    sizes, label = np.ones(len(v)), np.arange(len(v))
    while len(v) > 1:
        i, j = np.unravel_index(np.argmin(far), far.shape)
        if far[i, j] >= most:
            break
        merged = (far[i] * sizes[i] + far[j] * sizes[j]) / (sizes[i] + sizes[j])
        far[i], far[:, i] = merged, merged
        far[i, i] = np.inf
        far[j], far[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        label[label == j] = i
    return label


def clusters(memories: DataFrame) -> DataFrame:
    """user_id, cluster (smallest id), members, entities: similar live episodic memories with an entity in common.

    Average linkage within a component of memories that are nearer than LINKAGE
    to one another, pair by pair: it never merges across components, since the
    mean of two sides is under LINKAGE only if a pair of them is. So a task gets
    one component, not all that a user has.
    """
    rows = memories.where("valid_to is null and mem_type = 'episodic'").select("user_id", "id", "embedding", "entities")
    parts = near_parts(rows)

    def grouped(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id").reset_index(drop=True)
        label = average_linkage(np.stack(own.embedding.to_numpy()).astype(float))
        out = []
        for c in np.unique(label):
            some = own[label == c]
            shared = set.intersection(*(set(e) for e in some.entities)) if len(some) >= CLUSTER else set()
            if shared:
                out.append((some.user_id.iloc[0], some.id.min(), sorted(some.id), sorted(shared)))
        return pd.DataFrame(out, columns=["user_id", "cluster", "members", "entities"])

    kinds = {f.name: f.dataType.simpleString() for f in memories.schema}
    schema = f"user_id {kinds['user_id']}, cluster {kinds['id']}, members array<{kinds['id']}>, entities array<string>"
    return rows.join(parts, ["user_id", "id"]).groupBy("user_id", "part").applyInPandas(grouped, schema)


#: Vectors that others are measured from, and rows of a block; parameters.
PIVOTS, BLOCK = 32, 512


def near_pairs(rows: DataFrame, far: float = LINKAGE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """user_id, a, b of the ``rows`` (user_id, id, embedding) of one user that are nearer than ``far``, a < b; exact.

    A vector belongs to the cell of the pivot with the least angle to it, and a
    user's cell is cut into blocks. Angles obey the triangle inequality: two
    blocks can only have a pair if their pivots' angle is at most their largest
    angles and that of ``far`` together. Rows meet by pair of such blocks, never
    by user; and before vectors are multiplied, their angles to both pivots have
    to differ by that of ``far`` at most. Pivots are the rows with the least
    hashes. Vectors without a direction are near nothing.
    """
    limit = math.acos(1 - far) + 1e-6
    sized = rows.withColumn("size", F.sqrt(dot(F.col("embedding"), F.col("embedding")))).where("size > 0")
    sample = sized.select("id", F.transform("embedding", lambda x: x / F.col("size")).alias("v")).orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    centres = [[float(x) for x in r["v"]] for r in sample]
    if not centres:
        return rows.select("user_id", F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    table = F.array(*(F.array(*map(F.lit, c)) for c in centres))
    angle = lambda cosines: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosines)))
    known = sized.withColumn("angles", F.transform(table, lambda c: angle(dot(F.col("embedding"), c) / F.col("size"))))
    cell = F.array_position("angles", F.array_min("angles")).cast("int") - 1
    celled = checkpointed(known.select("user_id", "id", "embedding", "size", "angles", cell.alias("cell"), F.array_min("angles").alias("own")), "cells")
    counts = celled.groupBy("user_id", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    blocked = checkpointed(celled.join(counts, ["user_id", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks"), "blocks")
    blocks = blocked.groupBy("user_id", "cell", "block").agg(F.max("own").alias("reach"))
    between = np.arccos(np.clip(np.array(centres) @ np.array(centres).T, -1, 1))
    apart = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in between))
    one = blocks.select("user_id", F.col("cell").alias("cell_a"), F.col("block").alias("block_a"), F.col("reach").alias("reach_a"))
    two = blocks.select(F.col("user_id").alias("user_b"), F.col("cell").alias("cell_b"), F.col("block").alias("block_b"), F.col("reach").alias("reach_b"))
    # Blocks, not rows, are paired here: BLOCK * BLOCK times fewer.
    ordered = F.struct("cell_a", "block_a") <= F.struct("cell_b", "block_b")
    meet = F.get(F.get(apart, F.col("cell_a")), F.col("cell_b")) <= F.col("reach_a") + F.col("reach_b") + limit + 1e-6
    meetings = one.join(two, F.col("user_id") == F.col("user_b")).where(ordered & meet).select("user_id", "cell_a", "block_a", "cell_b", "block_b")
    a = blocked.select("user_id", F.col("cell").alias("cell_a"), F.col("block").alias("block_a"), F.col("id").alias("a"), F.col("embedding").alias("x"), F.col("size").alias("x_size"), F.col("angles").alias("x_angles"))
    b = blocked.select("user_id", F.col("cell").alias("cell_b"), F.col("block").alias("block_b"), F.col("id").alias("b"), F.col("embedding").alias("y"), F.col("size").alias("y_size"), F.col("angles").alias("y_angles"))
    meeting = ["user_id", "cell_a", "block_a", "cell_b", "block_b"]
    both = meetings.join(a, ["user_id", "cell_a", "block_a"]).join(meetings.join(b, ["user_id", "cell_b", "block_b"]), meeting)
    close = lambda cell: F.abs(F.get("x_angles", F.col(cell)) - F.get("y_angles", F.col(cell))) <= limit
    same = (F.col("cell_a") == F.col("cell_b")) & (F.col("block_a") == F.col("block_b"))
    near = both.where((~same | (F.col("a") < F.col("b"))) & close("cell_a") & close("cell_b")).where(1 - dot(F.col("x"), F.col("y")) / (F.col("x_size") * F.col("y_size")) < far)
    return near.select("user_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_parts(rows: DataFrame) -> DataFrame:
    """user_id, id, part (smallest id that it reaches) of the rows that are nearer than LINKAGE to another of their user."""
    pairs = near_pairs(rows)
    both = checkpointed(pairs.union(pairs.select("user_id", F.col("b"), F.col("a"))).toDF("user_id", "id", "near"))
    labels = checkpointed(both.groupBy("user_id", "id").agg(F.min("near").alias("near")).select("user_id", "id", F.least("near", "id").alias("part")))
    while True:
        # The least label of a memory and its neighbours, and then the label of that label.
        seen = both.join(labels.select("user_id", F.col("id").alias("near"), F.col("part").alias("low")), ["user_id", "near"]).groupBy("user_id", "id").agg(F.min("low").alias("low"))
        step = labels.join(seen, ["user_id", "id"]).select("user_id", "id", F.least("part", "low").alias("part"))
        after = step.join(step.select("user_id", F.col("id").alias("part"), F.col("part").alias("far")), ["user_id", "part"], "left")
        after = checkpointed(after.select("user_id", "id", F.least("part", F.coalesce("far", "part")).alias("part")))
        moved = after.join(labels.withColumnRenamed("part", "old"), ["user_id", "id"]).where("part <> old")
        if moved.isEmpty():
            return after
        labels = after


def rendered_cluster(members: DataFrame) -> DataFrame:
    """cluster, text of the members (cluster, id, valid_from, content) of clusters, in order of time: "[id] content"."""
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.col("content"))
    lines = F.array_sort(F.collect_list(F.struct("valid_from", "id", line.alias("line"))))
    return members.groupBy("cluster").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def consolidating(facts: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """The events that facts (id, cluster, content, confidence, supersedes, embedding) about the clusters found (user_id, cluster, members, entities) come to.

    Each fact of a known cluster with a text is written as a semantic memory from
    its members, with their common entities and a clamped confidence; then each
    memory that it supersedes is closed in its favour, if it is a member. Of
    several facts for one memory the first has it.
    """
    rows = facts.where(F.coalesce(F.trim("content"), F.lit("")) != "").join(found, "cluster")
    write = rows.select(
        "id", "user_id", F.lit("semantic").alias("mem_type"), "content", "entities", clamped(F.col("confidence").cast("string")).alias("confidence"), F.lit("consolidation").alias("created_by"),
        F.lit(None).cast("string").alias("source_session_id"), F.transform("members", lambda m: m.cast("string")).alias("source_ids"), "embedding", F.lit(None).cast(facts.schema["id"].dataType).alias("supersedes"),
        now.alias("at"), F.lit(0).alias("seq"), F.lit("write").alias("op"),
    )
    closing = rows.select("id", F.explode(F.array_intersect(F.array_distinct("supersedes"), "members")).alias("old"))
    new = {"id": F.col("id"), "supersedes": F.col("old"), "at": now, "seq": F.lit(1), "op": F.lit("supersede")}
    close = closing.select(*(new.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in write.schema))
    return write.unionByName(close)


def dry_run(memories: DataFrame, found: DataFrame) -> DataFrame:
    """user_id, live, clusters, clustered, unclustered: what a consolidation of the clusters found would read."""
    alive = memories.where("valid_to is null and mem_type = 'episodic'").groupBy("user_id").agg(F.count("*").alias("live"))
    sizes = found.groupBy("user_id").agg(F.count("*").alias("clusters"), F.sum(F.size("members")).alias("clustered"))
    rows = alive.join(sizes, "user_id", "left").select("user_id", "live", F.coalesce("clusters", F.lit(0)).alias("clusters"), F.coalesce("clustered", F.lit(0)).alias("clustered"))
    return rows.withColumn("unclustered", F.col("live") - F.col("clustered"))
