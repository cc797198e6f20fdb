"""Links between similar items, and their components, without all pairs of a group.

Items that share a band key may be similar.  Within a key, items are compared
with one leader first (the leader changes with each round), the exact measure
decides, and components are formed.  Only keys that still hold several
components are then searched for the remaining links.  Those of at most ``FEW``
items give all pairs between components, larger ones go block against block:
every item outside the key's largest component meets all items of other
components, in the order of their estimated similarity, until the exact measure
finds a link to each such component or no candidate is left.  So what a search
returns grows with the items and components, not with the pairs, and every
link between components that shares a key is found; links inside a component
change nothing and are not sought.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import common as C
from sitelens.llm.dart_minhash import MOST_BANDS

#: Items of one key that a task compares at once; larger groups are cut into blocks of about so many.
BLOCK = 8192
STAR_ROUNDS = 2
#: Up to so many items of one key meet in a join; a search, one group a key, takes longer than their pairs.
FEW = 16


def components(edges: DataFrame) -> DataFrame:
    """``(id, comp)`` for every end of ``edges(a, b)``; ``comp`` is the smallest id that can be reached.

    Each round takes the smallest label among the neighbours and then the label's own label, so the
    number of rounds grows with the logarithm of the longest path; every round is a written table.
    """
    both = C.write_once(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = C.write_once(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "cc-labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near")))
        step = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("comp").alias("further"))
        new = C.write_once(step.join(jump, "new").select("id", "old", F.least("new", "further").alias("comp")), "cc-labels")
        labels = new.select("id", "comp")
        if new.where("old != comp").isEmpty():
            return labels


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def similar_components(keys: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(id, comp)`` of all items that are linked to another one.

    ``keys(id, key)``: band keys with the band's number in the low bits (``band_keys``); ``sketches(id, keys
    array<long>, sketch binary)``: all keys of an item in the order of the bands, and one byte per coordinate, which
    only order the candidates of the search; ``sets(id, items array<long>)``: the exact sets, ascending as unsigned
    numbers, of every item that shares a key; items are linked at a Jaccard similarity of ``threshold`` or more.
    """
    C.ship(keys.sparkSession)
    # a key held by one item tells nothing
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = C.write_once(keys.join(shared, "key"), "links-keys")
    edges = comps = None
    for turn in range(STAR_ROUNDS):
        divided = _with_components(live, comps)
        if comps is not None:
            divided = divided.join(_divided(divided), "key", "left_semi")
        leaders = divided.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "comp")).alias("lead"))
        met = divided.join(leaders, "key").where("comp != lead.comp").select(F.col("id").alias("a"), F.col("lead.id").alias("b"))
        edges, comps = _grow(edges, comps, verified(C.write_once(_pairs(met), "links-pairs"), sets, threshold))
    divided = _with_components(live, comps)
    divided = C.write_once(divided.join(_divided(divided), "key", "left_semi"), "links-divided")
    few = divided.where(F.col("n") <= FEW)
    met = (few.select("key", F.col("id").alias("a"), F.col("comp").alias("ca")).join(few.select("key", F.col("id").alias("b"), F.col("comp").alias("cb")), "key")
           .where("a < b and ca != cb"))
    links = verified(C.write_once(_pairs(met), "links-pairs"), sets, threshold)
    return _grow(edges, comps, links.unionByName(_search(divided.where(F.col("n") > FEW), sketches, sets, threshold)).distinct())[1]


def _with_components(live: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return live.withColumn("comp", F.col("id"))
    return live.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _divided(rows: DataFrame) -> DataFrame:
    """Keys that hold several components."""
    return rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")


def _grow(edges, comps, found: DataFrame):
    found = C.write_once(found, "links-edges")
    if edges is not None:
        if found.isEmpty():
            return edges, comps
        found = edges.unionByName(found)
    return found, components(found)


def _search(divided: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: a link for every item and other component that share a key and are similar."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (divided.join(sketches, "id").join(sets, "id").withColumn("blocks", blocks)
             .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             # each pair of blocks meets once; a key within one block is one group
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "comp", "keys", "sketch", "items"))

    def compare(group: pa.Table) -> pa.Table:
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        band = group["key"][0].as_py() & (MOST_BANDS - 1)
        ids, comp, own = (group[c].to_numpy() for c in ("id", "comp", "own"))
        width = len(group["sketch"][0].as_py())
        table = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(ids), width)
        shared = group["keys"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        lists = group["items"].combine_chunks()
        flat, ends = lists.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        if lo == hi:  # everyone but the largest component against all
            names, sizes = np.unique(comp, return_counts=True)
            asks, asked = np.flatnonzero(comp != names[np.argmax(sizes)]), np.arange(len(ids))
        else:
            asks, asked = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        a, b = [], []
        for i in asks:
            near = asked[comp[asked] != comp[i]]
            # a pair that shares several keys is looked at under the first of them, which holds both components too
            near = near[(shared[near] == shared[i]).argmax(axis=1) == band]
            if not len(near):
                continue
            equal = (table[near] == table[i]).sum(axis=1)
            x, found = flat[ends[i]:ends[i + 1]], set()
            for j in near[np.lexsort((ids[near], -equal))]:
                if comp[j] in found:
                    continue
                y = flat[ends[j]:ends[j + 1]]
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if both / (len(x) + len(y) - both) >= threshold:
                    found.add(comp[j])
                    a.append(ids[i])
                    b.append(ids[j])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have a Jaccard similarity of ``threshold`` or more."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, "a").join(right, "b").where(small >= threshold * large)
            .withColumn("both", both).where(F.col("both") / (F.size("x") + F.size("y") - F.col("both")) >= threshold).select("a", "b"))
