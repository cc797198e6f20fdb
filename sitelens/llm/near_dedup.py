"""MinHash near-deduplication of documents with DartMinHash signatures.

A document is the set of its distinct five-word shingles (all of its words if
it has fewer than five); two documents are near duplicates at a Jaccard
similarity of 0.8 or more.  ``weights="count"`` weighs shingles by how often
they occur instead, for signatures and candidate search.

Documents with equal sets are one representative from the first aggregate on,
so a text copied a million times is one row per task before any shuffle.  The
representatives' signatures are cut into bands of ``ROWS`` coordinates; those
that share a band are compared by their exact sets (see ``links``), and linked
documents form classes through connected components.

With 24 bands of 6, a pair at similarity 0.8 shares a band with probability
1 - (1 - 0.8^6)^24 = 0.9993, one at 0.9 misses with less than 1e-7.

Defined cases: a null text is an empty one; a document without words is a
class of its own, whatever its copies; repeated rows and repeated or null ids
are rows of their own and copies of each other; ``class_id`` is the smallest
id in the class (null only if all its ids are null); exactly one row of a
class is kept, that of the smallest id, nulls last; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import common as C
from sitelens.llm import dart_minhash as D
from sitelens.llm import text_arrays as A
from sitelens.llm.links import similar_components

WIDTH = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 6
SEED = 12


def _sets(column: pa.Array, weights: str):
    """Per chunk of texts: first row, number of rows, owners, distinct shingles and weights."""
    for a, b in A.chunks(column):
        t = A.Texts(column.slice(a, b - a))
        begin, end, owner = t.words()
        words = t.hash_spans(begin, end)
        owners, hashes = A.shingles(words, owner, WIDTH)
        if weights == "count":
            every, first = A.windows(words, owner, WIDTH)
            mark = A.mix(hashes ^ A.seeded(owners.astype(np.uint64), 7))
            order = np.argsort(mark)
            seen = np.searchsorted(mark[order], A.mix(every ^ A.seeded(owner[first].astype(np.uint64), 7)))
            weight = np.maximum(np.bincount(order[seen], minlength=len(hashes)), 1).astype(float)
        else:
            weight = np.ones(len(hashes))
        yield a, t.n, owners, hashes, weight


def signed_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", weights: str = "set") -> DataFrame:
    """``(id, th1, th2, size, fp1, fp2, keys, sketch)`` per row: text and set fingerprints, band keys, sketch."""
    bands, rows = BANDS, ROWS

    def sign(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(3)
        out = {k: [] for k in ("size", "fp1", "fp2", "keys", "counts", "sketch")}
        for _, n, owners, hashes, weight in _sets(column, weights):
            size, fp1, fp2 = A.set_prints(owners, hashes, n)
            ranks = D.signatures(owners, hashes, weight, n, bands * rows, SEED)
            has = size > 0
            out["size"].append(size)
            out["fp1"].append(fp1)
            out["fp2"].append(fp2)
            out["keys"].append(D.band_keys(ranks, rows)[has].ravel())
            out["counts"].append(np.where(has, bands, 0))
            out["sketch"].extend(x.tobytes() for x in D.sketch(ranks))
        flat = {k: np.concatenate(v) for k, v in out.items() if k != "sketch"}
        return {
            "id": batch.column(0), "th1": batch.column(1), "th2": batch.column(2),
            "size": pa.array(flat["size"], pa.int64()), "fp1": pa.array(A.signed(flat["fp1"]), pa.int64()), "fp2": pa.array(A.signed(flat["fp2"]), pa.int64()),
            "keys": A.lists(A.signed(flat["keys"]), flat["counts"], pa.int64()), "sketch": pa.array(out["sketch"], pa.binary()),
        }

    rows_in = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("th1"), F.xxhash64(F.lit(1), text).alias("th2"), F.col(text).alias("text"))
    return C.map_batches(rows_in, sign, "id long, th1 long, th2 long, size long, fp1 long, fp2 long, keys array<long>, sketch binary")


def sets_of(docs: DataFrame, wanted: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, items)``: the shingle set of each ``wanted(id, doc, th1, th2)``, from the rows that hold those texts."""
    rows_in = docs.select(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text).alias("th1"), F.xxhash64(F.lit(1), text).alias("th2"), F.col(text).alias("text"))
    wanted = C.slim(wanted, "near-wanted")
    same = rows_in["doc"].eqNullSafe(wanted["doc"]) & (rows_in["th1"] == wanted["th1"]) & (rows_in["th2"] == wanted["th2"])
    found = rows_in.join(wanted, same).select("id", "text")

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        parts = [(np.bincount(owners, minlength=n), hashes) for _, n, owners, hashes, _ in _sets(batch.column(1), "set")]
        counts, hashes = (np.concatenate(x) for x in zip(*parts))
        return {"id": batch.column(0), "items": A.lists(A.signed(hashes), counts, pa.int64())}

    # a repeated row gives the same set twice
    return C.map_batches(found, cut, "id long, items array<long>").dropDuplicates(["id"])


def near_duplicate_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", weights: str = "set", threshold: float = THRESHOLD) -> DataFrame:
    """``(rid, doc_id, th1, th2, class_id, class_size, kept)`` per row of ``docs``."""
    return C.settled(lambda: _classes(docs, id_column, text, weights, threshold), "near-classes", docs.sparkSession)


def _classes(docs: DataFrame, id_column: str, text: str, weights: str, threshold: float) -> DataFrame:
    items = C.with_row_id(signed_documents(docs, id_column, text, weights), "near-signed")
    # partial sums first: a set held by a third of all rows is one row per task
    same = (items.where("size > 0").groupBy("fp1", "fp2").agg(F.min("rid").alias("rep")))
    same = C.write_once(same, "near-same")
    reps = items.join(same.select(F.col("rep").alias("rid")), "rid", "left_semi")
    keys = reps.select(F.col("rid").alias("id"), F.explode("keys").alias("key"))
    live = C.write_once(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").select("id").distinct(), "near-live")
    wanted = reps.join(live.withColumnRenamed("id", "rid"), "rid", "left_semi").select(F.col("rid").alias("id"), F.col("id").alias("doc"), "th1", "th2")
    sets = C.write_once(sets_of(docs, wanted, id_column, text), "near-sets")
    comps = similar_components(keys, reps.select(F.col("rid").alias("id"), "keys", "sketch"), sets, threshold)
    rows = (items.select("rid", "id", "th1", "th2", "fp1", "fp2", "size").join(same, ["fp1", "fp2"], "left")
            .withColumn("rep", F.when(F.col("size") > 0, F.col("rep")).otherwise(F.col("rid")))
            .join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
            .select("rid", "id", "th1", "th2", "comp"))
    classes = rows.groupBy("comp").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"),
                                       F.min(F.struct(F.col("id").isNull().alias("last"), "id", "rid")).alias("first"))
    return (rows.join(classes, "comp").select("rid", F.col("id").alias("doc_id"), "th1", "th2", "class_id", "class_size",
                                              (F.col("rid") == F.col("first.rid")).alias("kept")))


def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, and whether it is the one that stays."""
    docs = C.read_table(spark, sf_dir, "documents")
    return near_duplicate_classes(docs).select("doc_id", "class_id", "class_size", "kept")
