"""Substring deduplication: paragraphs by MinHash banding, passages inside them by aligned windows.

A paragraph is a line of at least ``LEAST_WORDS`` words, as the set of its
five-word shingles.  Its MinHash signature is cut into ``BANDS`` bands of
``ROWS``: at similarity 0.8 a pair shares a band with probability
1 - (1 - 0.8^4)^16 = 0.9998.  Paragraphs that collide are verified by the exact
Jaccard similarity and clustered through connected components (``links``).

A passage pasted into a longer line, or over several lines, is not similar to
a line as a whole.  So windows of ``WINDOW`` words begin where a word triple
has the smallest hash of any ``REACH`` in a row, and equal passages are cut at
equal places whatever stands around them (every passage of 46 words or
more has a window); equal windows are one class.  These are seeds.  Where the
holders of a seed change, the windows at all words up to ``REACH`` before and
after it are cut too (a repeated passage reaches no further without another
seed), and one between seeds that leave words out.  Windows that overlap and
have their first places side by side are joined, which gives the longest
repeated spans word by word.

Of each class that has two or more places, in several documents or in one
(kind ``repeat`` for such paragraphs), the first (by document id, then place)
stays and the others are to be removed.
Windows are taken from all lines, whether a paragraph class holds them or not,
and both kinds follow one order of places: whatever is removed stands at an
earlier place too, so what stays of a passage that is a line in some documents
and part of a line in others is its first place.

Defined cases: a null text is an empty one; rows alike in id and text are one
document; a null id is one document per text and comes last; lines that are
too short belong to no class; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm import common as C
from sitelens.llm import text_arrays as A
from sitelens.llm.dart_minhash import band_keys, sketch
from sitelens.llm.links import similar_components
from sitelens.session import run_scope

WIDTH = 5
THRESHOLD = 0.8
LEAST_WORDS = 25
BANDS = 16
ROWS = 4
WINDOW = 20
REACH = 25
LOW = (1 << 32) - 1

UNITS = "doc long, th long, line int, s int, e int, fp1 long, fp2 long, keys array<long>, sketch binary"


def minhash(owners: np.ndarray, hashes: np.ndarray, n: int, k: int) -> np.ndarray:
    """``n x k`` minima over each owner's hashes (owners sorted, none empty)."""
    out = np.zeros((n, k), np.uint64)
    begin = np.searchsorted(owners, np.arange(n))
    turn = A.seeded(np.arange(2 * k, dtype=np.uint64), 77)
    for j in range(k):
        out[:, j] = np.minimum.reduceat((hashes ^ turn[2 * j + 1]) * (turn[2 * j] | np.uint64(1)), begin)
    return out


class Lines:
    """The words of a chunk of texts, grouped by line."""

    def __init__(self, column: pa.Array):
        self.texts = A.Texts(column)
        t = self.texts
        self.begin, self.end, self.owner = t.words()
        breaks = np.concatenate(([0], np.cumsum(t.bytes == 0x0A)))
        before = breaks[self.begin] if len(self.begin) else np.zeros(0, np.int64)
        new = np.ones(len(before), bool)
        new[1:] = (before[1:] != before[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.line = np.cumsum(new) - 1  # of each word
        self.first = np.flatnonzero(new)
        self.last = np.concatenate((self.first[1:], [len(before)])).astype(np.int64) - 1 if len(self.first) else self.first
        self.sizes = self.last - self.first + 1
        self.doc = self.owner[self.first]
        self.number = before[self.first] - breaks[t.offsets[self.doc]]  # of the line within its text
        self.words = t.hash_spans(self.begin, self.end)

    def places(self, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.texts.code_points(np.concatenate((self.begin[first], self.end[last])), np.concatenate((doc, doc)))
        return both[:len(first)], both[len(first):]

    def sets(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of the chosen lines, owned by their place in ``lines``."""
        place = np.full(len(self.first), -1)
        place[lines] = np.arange(len(lines))
        own = place[self.line]
        chosen = own >= 0
        return A.shingles(self.words[chosen], own[chosen], WIDTH)


def _anchors(lines: Lines) -> np.ndarray:
    """Words at which a window begins: those with the smallest triple hash of any ``REACH`` in a row.

    Two texts that share ``REACH + WINDOW + 1`` words share a window, whatever stands around them.
    """
    n = len(lines.words)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    triple = np.full(n + 2 * REACH, np.uint64(2**64 - 1))
    triple[REACH:REACH + n - 2] = A.mix(lines.words[:-2] ^ A.seeded(lines.words[1:-1], 1) ^ A.seeded(lines.words[2:], 2))
    low = _sliding(triple, np.minimum)  # of the REACH hashes from each place on
    high = _sliding(low, np.maximum)  # the largest of those minima over all ranges that hold a place
    at = np.flatnonzero(high[1:n + 1] == triple[REACH:REACH + n])
    at = at[at <= n - WINDOW]
    return at[lines.owner[at] == lines.owner[at + WINDOW - 1]]


def _windows(lines: Lines, at: np.ndarray) -> dict[str, np.ndarray]:
    """The windows that begin at the words ``at``: place within the text (in words, and code points), fingerprint."""
    prints = np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        prints = A.mix(prints ^ A.seeded(lines.words[at + k], 5))
    s, e = lines.places(at, at + WINDOW - 1, lines.owner[at])
    return {"word": at - np.searchsorted(lines.owner, lines.owner[at]), "s": s, "e": e, "print": A.signed(prints)}


def _sliding(x: np.ndarray, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``REACH`` consecutive values."""
    out, width = x, 1
    while 2 * width <= REACH:
        out = best(out[:-width], out[width:])
        width *= 2
    rest = REACH - width
    return best(out[: len(out) - rest], out[rest:])


def units(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs (with band keys) and windows (without; ``line`` is the number of their first word) of every text."""
    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, th = batch.column(0), batch.column(1)
        out = {k: [] for k in ("row", "line", "s", "e", "fp1", "fp2", "keys", "counts")}
        sketches = []
        for a, b in A.chunks(batch.column(2)):
            x = Lines(batch.column(2).slice(a, b - a))
            whole = np.flatnonzero(x.sizes >= LEAST_WORDS)
            if len(whole):
                owners, hashes = x.sets(whole)
                _, fp1, fp2 = A.set_prints(owners, hashes, len(whole))
                ranks = minhash(owners, hashes, len(whole), BANDS * ROWS)
                s, e = x.places(x.first[whole], x.last[whole], x.doc[whole])
                for k, v in (("row", x.doc[whole] + a), ("line", x.number[whole]), ("s", s), ("e", e), ("fp1", A.signed(fp1)), ("fp2", A.signed(fp2)),
                             ("keys", A.signed(band_keys(ranks, ROWS).ravel())), ("counts", np.full(len(whole), BANDS))):
                    out[k].append(v)
                sketches += [r.tobytes() for r in sketch(ranks)]
            at = _anchors(x)
            if len(at):
                w = _windows(x, at)
                for k, v in (("row", x.owner[at] + a), ("line", w["word"]), ("s", w["s"]), ("e", w["e"]), ("fp1", w["print"]),
                             ("fp2", np.zeros(len(at), np.int64)), ("counts", np.zeros(len(at), np.int64))):
                    out[k].append(v)
                sketches += [None] * len(at)
        if not out["row"]:
            return None
        flat = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
        row = pa.array(flat["row"], pa.int64())
        return {"doc": ids.take(row), "th": th.take(row), "line": pa.array(flat["line"], pa.int32()), "s": pa.array(flat["s"], pa.int32()), "e": pa.array(flat["e"], pa.int32()),
                "fp1": pa.array(flat["fp1"], pa.int64()), "fp2": pa.array(flat["fp2"], pa.int64()), "keys": A.lists(flat["keys"], flat["counts"], pa.int64()), "sketch": pa.array(sketches, pa.binary())}

    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return C.map_batches(rows, cut, UNITS)


def line_sets(docs: DataFrame, wanted: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, items)``: the shingles of the lines ``wanted(id, doc, th, line)``."""
    per_doc = C.slim(wanted.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("line", "id"))).alias("asked")), "passages-asked")  # lines of one text
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    found = rows.join(per_doc, rows["doc"].eqNullSafe(per_doc["doc"]) & (rows["th"] == per_doc["th"])).select("asked.id", "asked.line", "text")

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, counts, hashes = [], [], []
        for a, b in A.chunks(batch.column(2)):
            x = Lines(batch.column(2).slice(a, b - a))
            place = {(d, n): i for i, (d, n) in enumerate(zip(x.doc.tolist(), x.number.tolist()))}
            names, chosen = [], []
            for r in range(a, b):
                for name, line in zip(batch.column(0)[r].as_py(), batch.column(1)[r].as_py()):
                    names.append(name)
                    chosen.append(place[(r - a, line)])
            owners, items = x.sets(np.array(chosen, np.int64))
            ids += names
            counts.append(np.bincount(owners, minlength=len(names)))
            hashes.append(items)
        return {"id": pa.array(ids, pa.int64()), "items": A.lists(A.signed(np.concatenate(hashes)), np.concatenate(counts), pa.int64())}

    return C.map_batches(found, cut, "id long, items array<long>").dropDuplicates(["id"])


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kind, s, e, class_id, class_docs, kept, th)``: every paragraph or longest passage that stands at several places."""
    spark = docs.sparkSession
    C.ship(spark)
    run = uuid.uuid4().hex
    try:
        with run_scope(run):
            every = C.with_row_id(units(docs, id_column, text), "passages-units", "id")
        lines, windows = every.where("sketch is not null"), every.where("sketch is null")
        found = C.settled(lambda: _paragraphs(docs, lines, id_column, text), "passages-lines", spark)
        texts = _texts(docs, id_column, text)
        # windows of every line, also of those that a class holds: the same passage may be a line here and part of one there
        seeds = C.write_once(_placed(windows.select("doc", "th", F.col("line").alias("word"), F.col("fp1").alias("class")), texts), "passages-places")
    finally:
        C.drop_materialized(spark, run)
    paragraphs = found.drop("line").withColumn("kind", F.when(F.col("class_docs") > 1, "paragraph").otherwise("repeat"))
    passages = C.settled(lambda: _passages(docs, seeds, texts, id_column, text), "passages-spans", spark)
    holders = passages.where("leads").groupBy("class").agg(F.count("*").alias("class_docs"))
    passages = passages.drop("leads").join(holders.hint("shuffle_hash"), "class").withColumn("kind", F.lit("passage"))
    return paragraphs.unionByName(passages).select(F.col("doc").alias("doc_id"), "kind", "s", "e", F.col("class").alias("class_id"), "class_docs", "kept", "th")


def _paragraphs(docs: DataFrame, lines: DataFrame, id_column: str, text: str) -> DataFrame:
    """Lines of the classes that have two places or more."""
    # partial sums first: a paragraph held by a third of all texts is one row per task
    same = C.write_once(lines.groupBy("fp1", "fp2").agg(F.min("id").alias("rep")), "passages-same")
    keys = lines.join(same.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.explode("keys").alias("key"))
    keys = C.write_once(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "key"), "passages-keys")
    # the few lines that share a key with another one
    near = C.write_once(lines.join(keys.select("id").distinct(), "id", "left_semi").select("id", "doc", "th", "line", "keys", "sketch"), "passages-near")
    sets = C.write_once(line_sets(docs, near.select("id", "doc", "th", "line"), id_column, text), "passages-sets")
    comps = similar_components(keys, near.select("id", "keys", "sketch"), sets, THRESHOLD)
    placed = (lines.join(same, ["fp1", "fp2"]).join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left")
              .select("doc", "th", "line", "s", "e", F.coalesce("comp", "rep").alias("class")))
    return _classes(placed)


def _classes(rows: DataFrame) -> DataFrame:
    """Rows of the classes that have two places or more; the first of a class is kept."""
    place = F.struct(F.col("doc").isNull().alias("last"), F.col("doc").alias("doc"), F.col("th").alias("th"), F.col("s").alias("s"))
    per_doc = rows.groupBy("class", "doc", "th").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    wide = per_doc.groupBy("class").agg(F.count("*").alias("class_docs"), F.min("first").alias("first"), F.max("last").alias("last")).where("first != last").drop("last")
    return rows.join(wide, "class").withColumn("kept", place == F.col("first")).drop("first")


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``(doc, th, rows, rid)`` of every document: its rows, and a number in the order of places (by id, then text), so
    that number and word, packed into one, are ordered as places are."""
    once = (docs.where(F.col(text).isNotNull()).groupBy(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text).alias("th")).agg(F.count("*").alias("rows"))
            .select(F.lit(0).alias("all"), F.col("doc").isNull().alias("last"), "doc", "th", "rows"))
    return C.write_once(C.numbered(once, "all", ["last", "doc", "th"], "rid", "passages-ranged").select("doc", "th", "rows", "rid"), "passages-texts")


def _holder() -> Column:
    return F.xxhash64(F.col("doc").isNull(), "doc", "th")


def _placed(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """``windows`` as class, place (number of the document, and word) and what they add to the class (``n``, ``who``)."""
    texts = C.slim(texts.select("doc", "th", "rid", _holder().alias("who")), "passages-holders")
    met = windows.join(texts, windows["doc"].eqNullSafe(texts["doc"]) & (windows["th"] == texts["th"]))
    return met.select("class", F.shiftleft("rid", 32).bitwiseOR(F.col("word").cast("long")).alias("place"), F.lit(1).cast("long").alias("n"), "who")


def _repeated(windows: DataFrame, *more: str) -> DataFrame:
    """The ``windows`` of two places or more, with their first place and what tells their holders (``n``, ``who``)."""
    wide = (windows.groupBy("class").agg(F.sum("n").alias("n"), F.bit_xor("who").alias("who"), F.min("place").alias("first"), F.max("place").alias("other"))
            .where("first != other").drop("other"))
    return windows.select("class", "place", *more).join(wide.hint("shuffle_hash"), "class")


def _passages(docs: DataFrame, seeds: DataFrame, texts: DataFrame, id_column: str, text: str) -> DataFrame:
    """The longest repeated spans around the seeds, classed by their first window; where the holders change within a
    span, it is given in overlapping pieces.  ``leads``: the first span of its class in its document."""
    rid, word = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit(LOW))
    live = _repeated(seeds).groupBy(rid.alias("rid")).agg(F.collect_list(F.struct(word.cast("int").alias("word"), "n", "who")).alias("live"))  # of one text
    windows = C.write_once(_windows_around(docs, live.join(texts, "rid").withColumn("who", _holder()), id_column, text), "passages-windows")
    if not texts.where("rows > 1").isEmpty():  # rows alike in id and text are one document
        windows = windows.where("rows = 1").unionByName(windows.where("rows > 1").dropDuplicates(["place"]))
    # as far from the first place as the window before: side by side with it there, too
    every = _repeated(windows, "span").select(rid.alias("rid"), "place", "class", "span", "n", "who", (F.col("place") - F.col("first")).alias("off"))
    order = Window.partitionBy("rid").orderBy("place")  # windows of one text
    same = F.col("place") - F.lag("place").over(order) <= WINDOW
    for c in ("n", "who", "off"):
        same &= F.lag(c).over(order) == F.col(c)
    runs = every.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    spans = (runs.groupBy("rid", "run").agg(F.min("span").alias("begin"), F.max("span").alias("end"), F.max(F.when(F.col("new") == 1, F.col("class"))).alias("class"), F.max("off").alias("off"))
             .withColumn("leads", F.row_number().over(Window.partitionBy("rid", "class").orderBy("begin")) == 1))
    return (spans.join(C.slim(texts.drop("rows"), "passages-documents"), "rid")
            .select("doc", "th", F.shiftright("begin", 32).cast("int").alias("s"), F.col("end").bitwiseAND(F.lit(LOW)).cast("int").alias("e"), "class", (F.col("off") == 0).alias("kept"), "leads"))


def _asked(owner: np.ndarray, word: np.ndarray, n: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and word of the windows to cut around seeds (ordered by both): every one up to ``REACH`` before and after
    a change of holders, and one between seeds that leave words out."""
    gap = word[1:] - word[:-1]
    joined = (owner[1:] == owner[:-1]) & (n[1:] == n[:-1]) & (who[1:] == who[:-1]) & (gap <= REACH)
    ends, begins = np.flatnonzero(np.append(~joined, True)), np.flatnonzero(np.append(True, ~joined))
    apart = np.flatnonzero(joined & (gap > WINDOW))
    steps = np.arange(1, REACH + 1)
    at = np.concatenate(((word[ends, None] + steps).ravel(), (word[begins, None] - steps).ravel(), word[apart] + REACH - WINDOW))
    return np.concatenate((np.repeat(owner[ends], REACH), np.repeat(owner[begins], REACH), owner[apart])), at


def _windows_around(docs: DataFrame, live: DataFrame, id_column: str, text: str) -> DataFrame:
    """The ``live`` windows of each text, those asked for around them, and what they add to their classes.

    One that is both counts twice.  Every row of a document gives all windows of the document (``rows``: how many do).
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    live = live.hint("shuffle_hash")
    found = rows.join(live, rows["doc"].eqNullSafe(live["doc"]) & (rows["th"] == live["th"])).select("rid", "rows", "who", "live", "text")

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = {k: [] for k in ("class", "place", "span", "n", "who", "rows")}
        rid, alike, who = (batch.column(k).to_numpy() for k in range(3))
        for a, b in A.chunks(batch.column(4)):
            x = Lines(batch.column(4).slice(a, b - a))
            lists = batch.column(3).slice(a, b - a)
            seeds = lists.flatten()
            owner = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
            word, n, tells = (seeds.field(k).to_numpy() for k in range(3))
            begin, end = np.searchsorted(x.owner, np.arange(b - a)), np.searchsorted(x.owner, np.arange(b - a), side="right")
            held, one = np.unique(begin[owner] + word, return_index=True)
            owner = owner[one]
            near, at = _asked(owner, held - begin[owner], n[one], tells[one])
            inside = (at >= 0) & (begin[near] + at + WINDOW <= end[near])
            asked = np.unique((begin[near] + at)[inside])
            every = np.union1d(asked, held)
            new, old = np.isin(every, asked), np.isin(every, held)
            w, row = _windows(x, every), x.owner[every] + a
            for k, v in (("class", w["print"]), ("place", rid[row] << 32 | w["word"]), ("span", w["s"] << 32 | w["e"]), ("n", new * alike[row] + old),
                         ("who", (new * alike[row] + old) % 2 * who[row]), ("rows", alike[row])):
                out[k].append(v)
        return {k: pa.array(np.concatenate(v), pa.int64()) for k, v in out.items()}

    return C.map_batches(found, cut, "class long, place long, span long, n long, who long, rows long")


def remove_passages(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the spans that ``found`` does not keep (overlaps are cut once).

    Spans belong to a text: the id and the fingerprint ``th``.  A ``found`` without ``th`` is read by the id alone
    and is for tables whose ids are their own.
    """
    owner = ["doc_id", "th"] if "th" in found.columns else ["doc_id"]
    spans = found.where("not kept").groupBy(*[F.col(c).alias(f"_{c}") for c in owner]).agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("_spans"))
    same = docs[id_column].eqNullSafe(spans["_doc_id"])
    joined = docs.join(spans, same & (F.xxhash64(docs[text]) == spans["_th"]) if "th" in found.columns else same, "left")
    whole = docs[text]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state, x):
        piece = F.substring(whole, state["at"] + 1, F.greatest(x["s"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(x["e"], state["at"]).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

    walked = F.aggregate("_spans", start, step)
    clean = F.concat(F.array_join(walked["out"], ""), F.substring(whole, walked["at"] + 1, F.length(whole)))
    return joined.select(*[F.when(F.col("_spans").isNull(), whole).otherwise(clean).alias(c) if c == text else docs[c] for c in docs.columns])


def passages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph or passage that stands at several places."""
    return repeated_passages(C.read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("th")
