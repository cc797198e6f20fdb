"""Ranked lexical search with a length-stratified index.

A document's score for an item sums, over the item's terms,

    w(term) * (1000000000 * tf  div  (1000 * tf + 12 * m))

where ``m`` depends on the document's length alone.  So all documents with one
``m`` form a *stratum*, within which a posting's impact depends on ``tf`` alone.

1. Documents become term vectors ``(term, tf)`` over the terms of the items (a
   term that no item holds can't score; every row is read, counted and indexed).
   The vectors are written once.
2. Counts over all of them give the number of documents, of terms, and each
   term's document frequency, and with them ``m`` and the weights.
3. The vectors are dealt by ranges of ``(m, row)``: documents of a stratum come
   together, and one that holds a third of all rows fills many partitions.
4. A task indexes ``BLOCK_DOCS`` documents at a time: postings by term, stratum
   and tf, with one impact computed for each pair of ``m`` and tf that occurs.
   The largest tf of a term in a stratum bounds what it can add there; an item
   visits the strata by falling sum of these bounds and ends when no bound
   reaches its k-th best score.
5. The best rows of each task meet in two rounds of ranking, first in ``SLOTS``
   parts of an item and then as a whole, so no task reads all of an item's rows.

Items are searched in groups of at most about ``ITEM_BYTES`` of text, so what a
task is handed is bounded whatever the number of items.

Defined cases: a null text has no terms, and so is no document to the counts and
never found; an item without terms, or whose terms no document holds, gives no
rows; repeated items and repeated documents are rows of their own, and rows alike
in score and id stand side by side in any order; a null id comes after all
others of its score; empty tables give no rows; of the documents only key and
text are read, so further columns with any names do no harm.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm import common as C

#: Places of an item's result.
BEST = 20
#: Documents that a task indexes at once; bytes of items that are searched at once, about; parts of an item's first ranking.
BLOCK_DOCS, ITEM_BYTES, SLOTS = 50_000, 16 << 20, 64
#: Bytes of text taken at once.
PART_BYTES = 8 << 20
#: Fixed values of the formula.
SCALE, TF_WEIGHT, M_WEIGHT, M_PERCENT = 1_000_000_000, 1000, 12, 25

#: Bytes of terms, A-Z lower-cased; all others become spaces.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def _terms(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many terms each text has, and all terms in order, dictionary-encoded."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    plain = data.to_pybytes()[offsets[0]:offsets[-1]].translate(_TERM_BYTES) if data is not None else b""
    texts = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(plain)])
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    real = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(column)), np.asarray(pc.list_value_length(lists)))[real.to_numpy(zero_copy_only=False)]
    return np.bincount(owner, minlength=len(column)), flat.filter(real).dictionary_encode()


def term_vectors(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """``(doc_id, n, terms, tfs)``: terms of each text, and how often it holds each term of the vocabulary (by number)."""
    C.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one group of items: bounded by ITEM_BYTES

    def part(keys: pa.Array, column: pa.Array, known: pa.Array) -> pa.RecordBatch:
        n, coded = _terms(column)
        number = pc.fill_null(pc.index_in(coded.dictionary.cast(pa.large_binary()), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        term = number[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(n)), n)[term >= 0]
        pairs, tf = np.unique(owner * len(known) + term[term >= 0], return_counts=True)
        bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(pairs // max(1, len(known)), minlength=len(n))))), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (pairs % max(1, len(known)), tf)]
        return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    def run(batches):
        known = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64()))
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PART_BYTES)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
                if b > a:
                    yield part(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), known)
                    C.give_back()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Strata:
    """The index of a block of documents, which come by ``m``."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray):
        order = np.argsort(m, kind="stable")
        place = np.empty(len(m), np.int64)
        place[order] = np.arange(len(m))
        self.ids, m = ids[order], m[order]
        levels, stratum = np.unique(m, return_inverse=True)
        self.edges = np.searchsorted(stratum, np.arange(len(levels) + 1))
        doc = place[owner]
        # one impact for each m and tf that occurs
        kinds, which = np.unique(m[doc] * (1 << 32) + tf, return_inverse=True)
        ms, tfs = kinds >> 32, kinds & ((1 << 32) - 1)
        impact = (SCALE * tfs) // (TF_WEIGHT * tfs + M_WEIGHT * ms)
        # postings by term, stratum and falling tf
        order = np.lexsort((-tf, stratum[doc], term))
        self.doc, self.impact = doc[order], impact[which[order]]
        cell = term[order] * len(levels) + stratum[self.doc]
        self.first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        self.past = np.append(self.first[1:], len(cell))[:len(self.first)]
        self.cell_term, self.cell_stratum = cell[self.first] // len(levels), cell[self.first] % len(levels)
        self.most = self.impact[self.first]  # the largest tf comes first
        self.scores = np.zeros(len(m), np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The best ``(ids, scores)``, given those of other blocks; weights count a term's repeats in the item."""
        begin, end = np.searchsorted(self.cell_term, terms), np.searchsorted(self.cell_term, terms, side="right")
        cells, weight = _spread(begin, end), np.repeat(weights, end - begin)
        bound = np.zeros(len(self.edges) - 1, np.int64)
        np.add.at(bound, self.cell_stratum[cells], weight * self.most[cells])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        at, width = 0, 1
        while at < len(order):
            ids, scores = best
            least = int(scores.min()) if len(scores) >= BEST else 1
            if bound[order[at]] < least:  # an equal bound may still bring a smaller id
                break
            chosen = order[at:at + width]
            chosen = chosen[bound[chosen] >= least]
            at, width = at + width, 2 * width
            own = np.zeros(len(bound), bool)
            own[chosen] = True
            mine = own[self.cell_stratum[cells]]
            begin, end = self.first[cells[mine]], self.past[cells[mine]]
            postings = _spread(begin, end)
            np.add.at(self.scores, self.doc[postings], np.repeat(weight[mine], end - begin) * self.impact[postings])
            seen = _spread(self.edges[chosen], self.edges[chosen + 1])
            found = self.scores[seen]
            good = found >= least
            best = _best(np.concatenate((ids, self.ids[seen[good]])), np.concatenate((scores, found[good])))
            self.scores[seen] = 0
        return best


def _spread(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = end - begin
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)


def _best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:BEST]
    return ids[order], scores[order]


def search_group(docs: DataFrame, items: list[tuple[int, str | None]], key: str, text: str) -> DataFrame | None:
    """``(item, doc_id, score)`` with the best rows of each task, for one group of items (number, text)."""
    spark = docs.sparkSession
    counted = [(number, Counter(terms_of(x))) for number, x in items]
    vocabulary = sorted(set().union(*(c for _, c in counted)))
    if not vocabulary:
        return None
    vectors = C.write_once(term_vectors(docs, vocabulary, key, text), "strata-vectors")
    n_docs, length = vectors.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    frequency = np.zeros(len(vocabulary), np.int64)
    for term, df in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of the group
        frequency[term] = df
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * frequency + 1))).astype(np.int64)
    number = {t: k for k, t in enumerate(vocabulary)}
    wanted = []
    for item, c in counted:
        terms = np.array(sorted(number[t] for t in c), np.int64)
        repeats = np.array([c[vocabulary[t]] for t in terms.tolist()], np.int64)
        wanted.append((item, terms, repeats * weight[terms]))
    shared = spark.sparkContext.broadcast([w for w in wanted if len(w[1])])
    C.ship(spark)
    nobody = np.iinfo(np.int64).max

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(shared.value)

        def search(block: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(block).combine_chunks()
            terms = table["terms"].combine_chunks()
            owner = np.repeat(np.arange(len(table)), np.asarray(pc.list_value_length(terms)))
            index = Strata(pc.fill_null(table["doc_id"], nobody).to_numpy(), table["m"].to_numpy(), owner, terms.flatten().to_numpy().astype(np.int64),
                           table["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64))
            for k, (_, own, weights) in enumerate(shared.value):
                best[k] = index.search(own, weights, best[k])

        block, rows = [], 0
        for batch in batches:
            block.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_DOCS:
                search(block)
                block, rows = [], 0
        if rows:
            search(block)
        for (item, _, _), (ids, scores) in zip(shared.value, best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=ids == nobody), pa.array(scores)], ["item", "doc_id", "score"])

    m = F.lit(100 - M_PERCENT) + F.expr(f"({M_PERCENT} * n * {n_docs}) div {length}")
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    strata = (vectors.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs", F.monotonically_increasing_id().alias("row"))
              .repartitionByRange(dealt, "m", "row").drop("row"))
    return strata.mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, item_key: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(item_key, rank, doc_id, score)``: each item's ``BEST`` highest-scoring documents; ``key`` is an integer."""
    spark = docs.sparkSession
    rows = C.with_row_id(items.select(F.col(item_key).alias("item_key"), F.col("text").alias("item_text")), "strata-items", "item")
    size = rows.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    groups = -(-size // ITEM_BYTES)
    found = None
    for g in range(groups):
        own = rows.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).select("item", "item_text").collect()  # about ITEM_BYTES
        part = search_group(docs, [tuple(r) for r in own], key, text)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    slot = found.withColumn("_slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))
    first = slot.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_slot").orderBy(*order))).where(F.col("_r") <= BEST)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= BEST)
    return last.join(rows.select("item", "item_key"), "item").select(F.col("item_key").alias(item_key), "rank", "doc_id", "score")


def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item, over all documents."""
    return ranked_search(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH_SQL = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term
  FROM documents WHERE text IS NOT NULL),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, sum(tf) AS n FROM postings GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n) AS terms FROM lengths),
strata AS (SELECT doc_id, CAST(100 - 25 + (25 * n * docs) // terms AS BIGINT) AS m FROM lengths, totals),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, docs),
wanted AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN strata USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
