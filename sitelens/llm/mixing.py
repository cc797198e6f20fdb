"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words; every document of a source is owed
the same fractional number of copies, target / source size.  The whole part is
given at once.  The fractional parts are rounded together by the pivotal
method, with document sizes as the mass: two undecided documents meet, words
are moved from one to the other (the direction is drawn so that every
document keeps its expected copies) until one of them is at 0 or 1, and the
other goes on.  The number of words owed never changes on the way, so a source
ends within one document of its target.

The meetings form a tree: documents are numbered within their source and cut
into blocks of ``FAN_IN``; each block leaves one undecided document, and those
are blocked again.  No block depends on the size of a source, so a source with
a third of all rows is rounded by as many tasks as it has blocks.  All of it is
DataFrame expressions.

Defined cases: a null text has size 0; documents of size 0 are taken 0 times;
a null source is a source of its own, last in order; repeated rows are rounded
one by one; with no words at all every target is 0; an empty table gives no
rows; draws are hashes of (seed, source, place), so reruns agree whatever the
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import common as C

FAN_IN = 256
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
SEED = 20_011


def source_targets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = MOST_COPIES) -> DataFrame:
    """``(src, source, source_size, target)`` from ``docs(source, size)``: shares by weight, stopped at
    ``cap`` times the source's size, what is over shared again by weight until none is above."""
    # partial sums first: a hot source is one row per task before the shuffle
    sizes = (docs.groupBy("source").agg(F.sum("size").alias("source_size"))
             .withColumn("_one", F.lit(0)).withColumn("_null", F.col("source").isNull().cast("int")))
    ranked = C.numbered(sizes, "_one", ["_null", "source"], "src", "mix-sources").drop("_one", "_null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    ranked = C.write_once(ranked.withColumn("weight", weight), "mix-weights")
    limit = F.col("source_size") * cap
    total = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level = None
    while True:  # the level only rises, and each round stops at least one more source
        stopped = F.lit(False) if level is None else limit <= F.col("weight") * level
        free, taken = ranked.agg(F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0)),
                                 F.coalesce(F.sum(F.when(stopped, limit)), F.lit(0.0))).first()
        new = (total - taken) / free if free else None
        if new is None or (level is not None and new <= level):
            break
        level = new
    target = F.least(limit.cast("double"), F.col("weight") * (level if level is not None else 0.0))
    if level is None:
        target = F.lit(0.0)
    return ranked.select("src", "source", "source_size", target.alias("target"))


def _draw(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), 11) / F.lit(float(1 << 53))


def _pivot(block: Column) -> Column:
    """One block of undecided documents ``(at, z, p, u, d)``: the decided ones ``out`` and the one left over."""
    first = F.element_at(block, 1)
    settled = F.array().cast("array<struct<at:bigint,z:bigint,d:bigint,pick:int>>")
    start = F.struct(first["at"].alias("at"), first["z"].alias("z"), first["p"].alias("p"), first["d"].alias("d"), settled.alias("out"))

    def meet(s: Column, x: Column) -> Column:
        room, owed = (1.0 - s["p"]) * s["z"], s["p"] * s["z"]
        x_room, x_owed = (1.0 - x["p"]) * x["z"], x["p"] * x["z"]
        rise, fall = F.least(room, x_owed), F.least(owed, x_room)
        up = x["u"] * (rise + fall) < fall  # chance fall / (rise + fall): expected copies stay
        decided = F.when(up, room <= x_owed).otherwise(owed <= x_room)  # whether the one carried so far is decided
        pick = F.when(up == decided, 1).otherwise(0)
        p = (F.when(up & decided, x["p"] - rise / x["z"]).when(up, s["p"] + rise / s["z"])
             .when(decided, x["p"] + fall / x["z"]).otherwise(s["p"] - fall / s["z"]))
        done = F.struct(F.when(decided, s["at"]).otherwise(x["at"]).alias("at"), F.when(decided, s["z"]).otherwise(x["z"]).alias("z"),
                        F.when(decided, s["d"]).otherwise(x["d"]).alias("d"), pick.alias("pick"))
        return F.struct(F.when(decided, x["at"]).otherwise(s["at"]).alias("at"), F.when(decided, x["z"]).otherwise(s["z"]).alias("z"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), F.when(decided, x["d"]).otherwise(s["d"]).alias("d"),
                        F.concat(s["out"], F.array(done)).alias("out"))

    return F.aggregate(F.slice(block, 2, F.size(block)), start, meet)


def round_fractions(units: DataFrame, seed: int = SEED, fan_in: int = FAN_IN) -> DataFrame:
    """``(src, d, z, pick)`` for ``units(src, at, d, z, p)``: ``p`` in (0, 1) rounded to 0 or 1, ``at`` gapless per ``src``."""
    most = units.agg(F.max("at")).first()[0]
    if most is None:
        return units.select("src", "d", "z", F.lit(0).alias("pick"))
    decided, level = [], 0
    current = units.select("src", F.col("at").alias("place"), "at", "d", "z", "p")
    while True:
        rows = current.withColumn("block", F.floor(F.col("place") / fan_in)).withColumn("u", _draw(seed, "src", level, "place"))
        listed = rows.groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("place", "at", "z", "p", "u", "d"))).alias("units"))
        met = C.write_once(listed.select("src", "block", _pivot(F.col("units")).alias("s")), f"mix-level{level}")
        decided.append(met.select("src", F.explode("s.out").alias("o")).select("src", "o.d", "o.z", "o.pick"))
        left = met.select("src", F.col("block").alias("place"), "s.at", "s.d", "s.z", "s.p")
        level += 1
        most //= fan_in
        if most == 0:  # one document per source is still undecided: a last draw
            decided.append(left.select("src", "d", "z", (_draw(seed, "src", level, "at") < F.col("p")).cast("int").alias("pick")))
            break
        current = left
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``(key, size, source_size, target, copies)`` for ``docs(key long, source, size)``; a key may repeat or be null."""
    docs = C.write_once(docs.select("key", "source", "size"), "mix-docs")
    targets = source_targets(docs, weights, share)
    owed = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST_COPIES))).otherwise(F.lit(0.0))
    rated = targets.withColumn("whole", F.floor(owed).cast("int")).withColumn("part", owed - F.floor(owed))
    rows = docs.join(rated, docs["source"].eqNullSafe(rated["source"])).select("key", "size", "src", "source_size", "target", "whole", "part")
    open_ = (F.col("size") > 0) & (F.col("part") > 0)
    # largest first: a large document carried on is decided on its way through the smaller ones, so what is
    # left undecided at the end is small
    units = C.numbered(rows.where(open_).withColumn("less", -F.col("size")), "src", ["less", "key"], "at", "mix-units")
    picked = round_fractions(units.select("src", "at", F.col("key").alias("d"), F.col("size").alias("z"), F.col("part").alias("p")), seed)
    by_source = rated.select("src", "source_size", "target", "whole")
    given = (picked.join(by_source, "src")
             .select(F.col("d").alias("key"), F.col("z").alias("size"), "source_size", "target", (F.col("whole") + F.col("pick")).alias("copies")))
    closed = rows.where(~open_).select("key", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("copies"))
    return given.unionByName(closed)


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = C.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", C.word_count().alias("size"))
    return mix(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target",
                            (F.col("copies") * F.col("size")).cast("long").alias("taken"))
