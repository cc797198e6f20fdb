"""Sharding by balanced label propagation, under the law of rows.

Documents are linked when they share a link key (here: equal texts; a document
may have several keys).  Every document starts in a hashed shard.  A round
counts, per link, its documents in each shard, sums these votes per document
(its own included) and moves documents to the shard with most votes, as far as
that shard has room; ties go to a shard with room that depends on the link
alone, so linked documents agree.  Shards without room are out of the vote, so a group
larger than a shard fills one after another.  Requests reach the driver only
as a histogram (shard x gain x 64 hash classes).

At the end every shard keeps at most its share of the rows, linked documents
first; the others fill the free places.  Shard counts differ by one at most.

Defined cases: a null text links to nothing, has size 1 and the CRC of no
bytes; equal empty texts are linked; repeated rows and repeated or null ids are
rows of their own; with fewer rows than shards some shards stay empty; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import common as C

SHARDS = 16
ROUNDS = 8
CLASSES = 64


def _shares(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _accepted(wishes: list, room: list[int]) -> dict[int, list[tuple[int, int]]]:
    """Per target shard the (gain class, hash class) cells that fit into its room, largest gains first."""
    out: dict[int, list[tuple[int, int]]] = {}
    for w in sorted(wishes, key=lambda w: (w["best"], -w["worth"], w["part"])):
        if room[w["best"]] >= w["n"]:
            room[w["best"]] -= w["n"]
            out.setdefault(w["best"], []).append((w["worth"], w["part"]))
    return out


def propagate(links: DataFrame, rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``(rid, shard)`` for every document of ``links(rid, link)``; ``rows`` counts all documents, linked or not."""
    share = _shares(rows, shards)
    state = C.write_once(links.groupBy("rid").agg(F.min("link").alias("first")).withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")), "shard-state")
    for turn in range(rounds):
        counts = links.join(state, "rid").groupBy("link").agg(*[F.count_if(F.col("shard") == s).alias(f"c{s}") for s in range(shards)])
        held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row per shard
        room = [max(0, share[s] - held.get(s, 0)) for s in range(shards)]
        votes = (links.join(counts, "link").groupBy("rid").agg(*[F.sum(f"c{s}").alias(f"v{s}") for s in range(shards)]).join(state, "rid"))
        rank = F.pmod(F.xxhash64("first"), F.lit(shards))
        options = [F.when((F.lit(room[s]) > 0) | (F.col("shard") == s),
                          F.struct(F.col(f"v{s}").alias("v"), (F.pmod(F.lit(s) + rank, F.lit(shards)) if room[s] else F.lit(-1)).cast("int").alias("tie"), F.lit(s).alias("s")))
                   for s in range(shards)]
        own = F.element_at(F.array(*[F.col(f"v{s}") for s in range(shards)]), F.col("shard") + 1)
        wish = (votes.withColumn("top", F.greatest(*options)).select("rid", "first", "shard", F.col("top.s").alias("best"), sum(F.col(f"v{s}") for s in range(shards)).alias("linked"), F.col("top.v").alias("most"), (F.col("top.v") - own).alias("gain"))
                # a small group that is split over full shards moves on as a whole
                .withColumn("best", F.when(_stuck(room, share), _refuge(room)).otherwise(F.col("best")))
                .withColumn("worth", F.when(F.col("gain") > 0, F.floor(F.log2(F.col("gain").cast("double")))).otherwise(-1).cast("int"))
                # documents of one link are in one class, so that groups move together, unless they would overfill it
                .withColumn("part", F.pmod(F.xxhash64(F.when(F.col("linked") * CLASSES <= min(share), F.col("first")).otherwise(F.col("rid")), F.lit(turn)), F.lit(CLASSES)).cast("int")))
        wish = C.write_once(wish, "shard-wish")
        wanted = wish.where("best != shard").groupBy("best", "worth", "part").agg(F.count("*").alias("n")).collect()  # a histogram
        moves = _accepted(wanted, room)
        if not moves:
            break
        state = C.write_once(wish.withColumn("shard", F.when(_moves(moves), F.col("best")).otherwise(F.col("shard"))).select("rid", "first", "shard"), "shard-state")
    return state.select("rid", "shard")


def _stuck(room: list[int], share: list[int]) -> Column:
    full = F.element_at(F.array(*[F.lit(r == 0) for r in room]), F.col("shard") + 1)
    return full & (F.col("best") == F.col("shard")) & (F.col("most") < F.col("linked")) & (F.col("linked") * CLASSES <= min(share)) & F.lit(any(room))


def _refuge(room: list[int]) -> Column:
    """A shard with room that depends on the link alone."""
    free = [s for s, r in enumerate(room) if r] or [0]
    return F.element_at(F.array(*[F.lit(s) for s in free]), (F.pmod(F.xxhash64("first", F.lit(1)), F.lit(len(free))) + 1).cast("int"))


def _moves(moves: dict[int, list[tuple[int, int]]]) -> Column:
    tests = [(F.col("best") == s) & (F.col("worth") * CLASSES + F.col("part")).isin([w * CLASSES + p for w, p in cells]) for s, cells in moves.items()]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out & (F.col("best") != F.col("shard"))


def place(wished: DataFrame, rows: int, shards: int = SHARDS) -> DataFrame:
    """``(rid, shard, slot)``: every row of ``wished(rid, shard, linked)`` in a shard, with counts at most one apart."""
    share = _shares(rows, shards)
    limit = F.element_at(F.array(*[F.lit(n) for n in share]), F.col("shard") + 1)
    first = C.numbered(wished.withColumn("late", (~F.col("linked")).cast("int")), "shard", ["late", "link", "rid"], "slot", "shard-place")
    held = {r["shard"]: r["n"] for r in wished.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row per shard
    kept = [min(share[s], held.get(s, 0)) for s in range(shards)]
    over = C.numbered(first.where(F.col("slot") >= limit).select("rid", "link", F.lit(0).alias("pool")), "pool", ["link", "rid"], "turn", "shard-pool")
    target, slot, begin = None, None, 0
    for s in range(shards):  # the free places, shard by shard
        free = share[s] - kept[s]
        test = F.col("turn") < begin + free
        where, at = F.lit(s), F.col("turn") - begin + kept[s]
        target = F.when(test, where) if target is None else target.when(test, where)
        slot = F.when(test, at) if slot is None else slot.when(test, at)
        begin += free
    return (first.where(F.col("slot") < limit).select("rid", "shard", "slot")
            .unionByName(over.select("rid", target.cast("int").alias("shard"), slot.cast("long").alias("slot"))))


def shard_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` per row, equal texts linked."""
    clean = C.text_or_empty(text)
    base = C.with_row_id(docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(clean) + 1).cast("long").alias("size"), F.crc32(clean.cast("binary")).alias("text_crc32"),
                                     F.when(F.col(text).isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))).alias("mark")), "shard-base")
    rows = base.count()
    # partial sums first: a text held by a third of all rows is one row per task
    groups = base.where("mark is not null").groupBy("mark").agg(F.min("rid").alias("link"), F.count("*").alias("n")).where("n > 1")
    links = C.write_once(base.select("rid", "mark").join(groups, "mark").select("rid", "link"), "shard-links")
    state = propagate(links, rows, shards)
    wished = (base.select("rid").join(links, "rid", "left").join(state, "rid", "left")
              .select("rid", F.coalesce("link", F.lit(-1)).alias("link"), F.col("link").isNotNull().alias("linked"),
                      F.coalesce("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")).alias("shard")))
    placed = place(C.write_once(wished, "shard-wished"), rows, shards)
    return base.join(placed, "rid").select("doc_id", "size", "text_crc32", "shard", "slot")


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and place of every document."""
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
