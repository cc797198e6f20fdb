"""Periodic runs in word sequences: suffix-tree LCE and Lyndon roots.

The words of a text are numbered by their spelling, and the runs of the
resulting sequence are found as follows.

1. Ukkonen's algorithm builds the suffix tree of the sequence and that of its
   reversal.
2. A walk round each tree gives the order of its leaves and, between two
   neighbours, the depth of the shallowest node passed.  That part of the Euler
   tour is all a question about two leaves can touch; a sparse table over it
   answers "lowest common ancestor of two leaves", and so the longest common
   extension (LCE) of two places, in constant time, forwards and backwards.
3. For an order of the words and for its reverse, the longest Lyndon word that
   begins at each place ends at the next smaller suffix.  Every run has such a
   word of one of the two orders as a root (the "runs theorem"), so the 2n words
   are all candidates there are.
4. Each candidate is extended in both directions by one LCE; what is at least
   twice as long as its root is a run, and the root's length is its smallest
   period.

Only parts of a text that can hold a long run go through the trees: in a run of
at least 24 words and three periods, every sequence of eight words occurs a
second time in the run.  Stretches whose eight-word sequences all repeat within
their text are found by hashing (a collision can only add a stretch), and no run
crosses the border of one.  Stretches of several texts share a tree, parted by
symbols that occur once; the work and memory of a tree are linear in its words
(``n log n`` for the table), so one very long text is no special case.

Nothing is shuffled: texts are independent, and one scan gives the result.

Defined cases: a null or blank text has no words and no runs; rows are judged
one by one, so repeated and null keys stay rows of their own; an empty table
gives no rows; only the key and the text are read, so further columns with any
names do no harm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import common as C
from sitelens.llm.text_arrays import mix

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a sequence that must repeat in a stretch: a third of the least run.
GRAM = LEAST_WORDS // LEAST_PERIODS
#: Bytes of text taken at once, and words that share a tree (a longer stretch has a tree of its own).
PART_BYTES, TREE_WORDS = 4 << 20, 1 << 15


def suffix_tree(s: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ukkonen's suffix tree of ``s``, whose last symbol occurs once; symbols are below ``width``.

    Returns, for each node, its parent and the places where the label of its edge begins and ends (node 0 is the
    root), and the leaf of each suffix in the order of their first places.
    """
    n = len(s)
    start, stop, link, parent = [0], [0], [0], [-1]
    leaves: list[int] = []
    edge: dict[int, int] = {}
    node = at = length = pending = 0  # the active point: node, edge beginning with s[at], symbols down that edge
    for i, c in enumerate(s):
        pending += 1
        last = 0  # the inner node that still has no suffix link
        while pending:
            if not length:
                at = i
            key = node * width + s[at]
            child = edge.get(key)
            if child is None:
                leaf = len(start)
                start.append(i), stop.append(n), link.append(0), parent.append(node)
                leaves.append(leaf)
                edge[key] = leaf
                if last:
                    link[last] = node
                    last = 0
            else:
                first = start[child]
                long = stop[child] - first
                if length >= long:
                    at += long
                    length -= long
                    node = child
                    continue
                if s[first + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                mid = len(start)
                leaf = mid + 1
                start += (first, i)
                stop += (first + length, n)
                link += (0, 0)
                parent += (node, mid)
                leaves.append(leaf)
                edge[key] = mid
                start[child] = first + length
                parent[child] = mid
                edge[mid * width + s[first + length]] = child
                edge[mid * width + c] = leaf
                if last:
                    link[last] = mid
                last = mid
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - pending + 1
    return np.array(parent), np.array(start), np.array(stop), np.array(leaves)


class Extensions:
    """Longest common extensions of places of a sequence, in constant time each."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        parent, start, stop, leaves = suffix_tree(s.tolist(), int(s.max()) + 1)
        suffix = np.full(len(parent), -1)
        suffix[leaves] = np.arange(n)
        # children side by side, by parent and then by the first symbol of their edge
        order = np.lexsort((s[start[1:]], parent[1:])) + 1
        children = order.tolist()
        bounds = np.searchsorted(parent[order], np.arange(len(parent) + 1)).tolist()
        long, of = (stop - start).tolist(), suffix.tolist()
        places, valleys = [], []  # the leaves in the order of the walk, and the depth passed on the way to each
        stack = [(0, 0, 0)]
        low = 0
        while stack:
            v, depth, turn = stack.pop()
            if turn >= 0:
                low = turn  # a walk that comes back to a node and goes on passes it as the shallowest one
            if of[v] >= 0:
                places.append(of[v])
                valleys.append(low)
                continue
            if v:
                depth += long[v]
            a, b = bounds[v], bounds[v + 1]
            for k in range(b - 1, a, -1):
                stack.append((children[k], depth, depth))
            if b > a:
                stack.append((children[a], depth, -1))
        self.rank = np.empty(n + 1, np.int64)
        self.rank[np.array(places)] = np.arange(n)
        self.rank[n] = 0
        self.n = n
        table = [np.array(valleys[1:], np.int32)]
        while 2 ** len(table) <= n - 1:
            half = table[-1]
            step = 2 ** (len(table) - 1)
            table.append(np.minimum(half[:-step], half[step:]))
        self.table = table

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different places, how many symbols agree from there on."""
        x, y = self.rank[a], self.rank[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        out = np.zeros(len(a), np.int64)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        inside = (a < self.n) & (b < self.n) & (hi > lo)
        for k in np.unique(level[inside]).tolist():
            own = np.flatnonzero(inside & (level == k))
            out[own] = np.minimum(self.table[k][lo[own]], self.table[k][hi[own] - 2 ** k])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each place the next place of a smaller rank (the length of the list, if none)."""
    n = len(rank)
    out = [n] * n
    waiting: list[int] = []
    for i, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def runs_of(codes: np.ndarray) -> np.ndarray:
    """All runs of a sequence of numbers: rows ``(start, length, period)``, every run once, by start and period."""
    n = len(codes)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    kinds, s = np.unique(codes, return_inverse=True)
    end = [len(kinds)]  # a last symbol of its own
    ahead = Extensions(np.concatenate((s, end)))
    back = Extensions(np.concatenate((s[::-1], end)))
    rank = ahead.rank[:n + 1]
    found = []
    for order in (rank, n - rank):  # the order of the suffixes, and that for the words in reverse order
        j = np.array(next_smaller(order.tolist()))[:n]
        i = np.flatnonzero(j <= n)
        j = j[i]
        period = j - i
        right = ahead(i, j)
        left = back(np.where(i > 0, n - i, n + 1), n - j)
        length = left + (j - i) + right
        good = length >= 2 * period
        found.append(np.stack(((i - left)[good], length[good], period[good]), axis=1))
    return np.unique(np.concatenate(found), axis=0)


def stretches(codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """``(first, past the last)`` of the stretches that can hold a long run; ``offsets``: where each text begins and ends."""
    n = len(codes)
    if n < LEAST_WORDS:
        return []
    code = mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0x2545F4914F6CDD1D) + code[k:k + len(grams)]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    grams = mix(grams + mix(text[:len(grams)].astype(np.uint64)))
    whole = text[GRAM - 1:] == text[:len(grams)]
    ordered = np.sort(grams)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    seen = np.zeros(1 << 20, bool)
    seen[(twice >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(whole & seen[(grams >> np.uint64(44)).astype(np.int64)])
    if not len(maybe):
        return []
    place = np.minimum(np.searchsorted(twice, grams[maybe]), len(twice) - 1)
    marked = np.zeros(len(grams) + 2, bool)
    marked[maybe[twice[place] == grams[maybe]] + 1] = True
    edges = np.flatnonzero(marked[1:] != marked[:-1])
    first, past = edges[::2], edges[1::2] + GRAM - 1
    long = past - first >= LEAST_WORDS
    return list(zip(first[long].tolist(), past[long].tolist()))


def long_runs(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``(text, start, length, period)`` of the long runs of texts that stand behind one another, start within the text."""
    parts = stretches(codes, offsets)
    out = []
    while parts:
        together, size = [], 0
        while parts and (not together or size + parts[-1][1] - parts[-1][0] <= TREE_WORDS):
            together.append(parts.pop())
            size += together[-1][1] - together[-1][0]
        sequence, at, shift, length = [], [], [], 0
        apart = int(codes.max()) + 1
        for k, (a, b) in enumerate(together):  # a symbol of its own after each stretch
            at.append(length)
            shift.append(a - length)
            length += b - a + 1
            sequence += (codes[a:b], [apart + k])
        runs = runs_of(np.concatenate(sequence))
        runs = runs[runs[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * runs[:, 2])]
        runs[:, 0] += np.array(shift)[np.searchsorted(at, runs[:, 0], side="right") - 1]
        out.append(runs)
    if not out:
        return np.zeros((0, 4), np.int64)
    runs = np.concatenate(out)
    text = np.searchsorted(offsets, runs[:, 0], side="right") - 1
    runs = np.column_stack((text, runs[:, 0] - offsets[text], runs[:, 1:]))
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Where each text's words begin and end, the words as numbers, and the spellings."""
    lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    flat = lists.flatten()
    real = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(column)), np.asarray(pc.list_value_length(lists)))[real.to_numpy(zero_copy_only=False)]
    coded = flat.filter(real).dictionary_encode()
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(column)))))
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.large_binary()).to_pylist()


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per row the key, ``n_words``, ``runs`` (start, length and period, by start and period) and ``collapsed``: the
    words joined by one space, without those that a run holds after its first period.

    ``digests``: the hexadecimal SHA-256 of ``collapsed`` instead of the text itself.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = [key, "n_words", "runs", "collapsed"]

    def part(keys: pa.Array, column: pa.Array) -> pa.RecordBatch:
        offsets, codes, spelling = _words(column)
        runs = long_runs(codes, offsets)
        change = np.zeros(len(codes) + 1, np.int64)
        first = offsets[runs[:, 0]] + runs[:, 1]
        np.add.at(change, first + runs[:, 3], 1)
        np.add.at(change, first + runs[:, 2], -1)
        kept = np.cumsum(change[:-1]) == 0
        collapsed = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            joined = b" ".join(map(spelling.__getitem__, codes[a:b][kept[a:b]].tolist()))
            collapsed.append(hashlib.sha256(joined).hexdigest() if digests else joined.decode())
        values = pa.StructArray.from_arrays([pa.array(runs[:, k], pa.int64()) for k in (1, 2, 3)], ["start", "length", "period"])
        bounds = np.concatenate(([0], np.cumsum(np.bincount(runs[:, 0], minlength=len(column)))))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values).cast(run_type)
        return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets), pa.int64()), lists, pa.array(collapsed, pa.string())], names)

    def run(batches):
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64()))
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PART_BYTES)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
                if b > a:
                    yield part(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))
                    C.give_back()

    C.ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def periodic_text(doc_id: Column, text: Column) -> Column:
    """The text the query looks at: where ``crc32(doc_id)`` says so, the words from place ``a`` on repeat with period ``p``."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(f"({C.WORD})"), F.lit(1))

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.transform(F.array(F.struct(n.alias("n"), F.pmod(g, n).alias("a"))), lambda x: F.array_join(F.transform(
            w, lambda word, i: F.when(i < x["a"], word).otherwise(
                F.get(w, (x["a"] + F.pmod(i - x["a"], F.floor((x["n"] - x["a"]) / (3 + F.pmod(g, F.lit(8)))).cast("long") + 1)).cast("int")))), " "))[0]

    changed = F.transform(F.array(words), repeat)[0]
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(C.WORD), changed).otherwise(text)


def periodic_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long runs of every document's word sequence, the strongest of them, and the text without their repetitions."""
    docs = C.read_table(spark, sf_dir, "documents")
    found = collapse_runs(docs.select("doc_id", periodic_text(F.col("doc_id"), F.col("text")).alias("text")), digests=True)
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # exponents are compared exactly, as products; runs come by start and period, so the first of equals stays
    best = F.reduce("runs", nothing, lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
