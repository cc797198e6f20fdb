"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Fit, on a bounded sample: vectors are centred, spread over ``BITS`` directions
by a matrix with orthogonal blocks, and the rotations are turned so that signs
lose least (iterative quantisation).  The Hamming radius is the distance within
which the sample's own nearest neighbours lie (``COVER`` of them); the whole
table is denser than the sample, so its neighbours are nearer.

Index: all rows are dealt into blocks by a hash of their row number, each small enough
for one task.  A block cuts its codes into ``PIECES`` substrings and sorts the
rows by each.  A code within radius r of a query differs by at most r // PIECES
bits in some substring (one bit less in all but the first r % PIECES + 1), so
probing those values finds every code within the radius.  What is found is
ranked by exact distances of the original vectors in double precision.  A
block that holds fewer than k rows within the radius widens it until it has k
or is exhausted, so a query always gets k neighbours where there are k.

Defined cases: vectors that are null, all zero, or hold null or non-finite
components take no part; nor do vectors of another length than the sample's
most frequent one, or rows with a null id; repeated ids are rows of their own:
each row that is a query has its own ten neighbours and leaves out itself alone;
ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm import common as C

SAMPLE = 4096
BITS = 128
PIECES = 8
COVER = 0.97
#: Rows of one index block, about; a task holds one block.
BLOCK_ROWS = 16_384
NEIGHBOURS = 10
TURNS = 20


class Coder:
    """The learned map from vectors to codes, and the radius."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, k: int = NEIGHBOURS, cover: float = COVER, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centre = sample.mean(axis=0)
        x = sample - self.centre
        d = x.shape[1]
        blocks = []
        for _ in range(math.ceil(bits / d)):
            turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
            for _ in range(TURNS):  # the rotation that brings the vectors nearest to their signs
                y = x @ turn
                u, _, v = np.linalg.svd(x.T @ np.where(y >= 0, 1.0, -1.0), full_matrices=False)
                turn = u @ v
            blocks.append(turn)
        self.turn = np.concatenate(blocks, axis=1)[:, :bits]
        self.bits = bits
        self.radius = self._radius(sample, k, cover)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One row of bytes per vector."""
        return np.packbits((x - self.centre) @ self.turn >= 0, axis=1)

    def _radius(self, sample: np.ndarray, k: int, cover: float) -> int:
        asks = sample[: max(1, min(len(sample) // 4, 512))]
        codes, asked = self.codes(sample), self.codes(asks)
        far = []
        for i, (v, c) in enumerate(zip(asks, asked)):
            dist = ((sample - v) ** 2).sum(axis=1)
            dist[i] = np.inf
            near = np.argsort(dist, kind="stable")[: min(k, len(sample) - 1)]
            far.extend(np.bitwise_count(codes[near] ^ c).sum(axis=1))
        return int(np.quantile(far, cover, method="higher")) if far else self.bits


class Block:
    """The multi-index of one block of rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, coder: Coder, pieces: int = PIECES):
        self.rows, self.ids, self.vectors, self.coder, self.pieces = rows, ids, vectors, coder, pieces
        self.codes = coder.codes(vectors)
        width = coder.bits // pieces // 8
        self.values = np.ascontiguousarray(self.codes.reshape(len(ids), pieces, width)).view(f"u{width}")[:, :, 0]
        self.tables = []
        for j in range(pieces):  # the distinct values of a substring, and the rows that hold each
            order = np.argsort(self.values[:, j], kind="stable")
            values, begin, counts = np.unique(self.values[order, j], return_index=True, return_counts=True)
            self.tables.append((order, values, begin, counts))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits."""
        found = np.zeros(len(self.ids), bool)
        parts = np.ascontiguousarray(code.reshape(self.pieces, -1)).view(self.values.dtype)[:, 0]
        per, over = divmod(radius, self.pieces)
        for j, (order, values, begin, counts) in enumerate(self.tables):
            reach = per if j <= over else per - 1
            if reach < 0:
                continue
            # the probe: all values at most ``reach`` bits from the query's own substring that occur in the block
            hit = np.flatnonzero(np.bitwise_count(values ^ parts[j]) <= reach)
            if len(hit):
                mark = np.zeros(len(order) + 1, np.int32)
                mark[begin[hit]] += 1
                np.add.at(mark, begin[hit] + counts[hit], -1)
                found[order[np.cumsum(mark[:-1]) > 0]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]

    def nearest(self, query: int, vector: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, ids and distances of the block's best ``k`` of the rows found; ``query`` is the row that asks."""
        radius = self.coder.radius
        others = int((self.rows != query).sum())
        while True:
            rows = self.within(code, radius)
            rows = rows[self.rows[rows] != query]
            if len(rows) >= min(k, others) or radius >= self.coder.bits:
                break
            radius = min(self.coder.bits, radius + self.pieces)
        dist = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(axis=1))
        best = np.lexsort((self.rows[rows], self.ids[rows], dist))[:k]
        return self.rows[rows[best]], self.ids[rows[best]], dist[best]


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, v array<double>)`` of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), finite.alias("finite"), F.exists(v, lambda x: x != 0).alias("some"))
            .where("id is not null and v is not null and finite and some").select("id", "v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit(rows: DataFrame, sample: int = SAMPLE) -> Coder | None:
    """A coder learned from at most ``sample`` rows, chosen by a hash of their id."""
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None
    chosen = C.hashed_sample(rows.where(F.size("v") == sizes[0]["d"]), F.struct("id", "v"), sample).toPandas().sort_values("id", kind="stable")
    return Coder(np.stack(chosen["v"].to_numpy()).astype(float))


def search(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each row that ``is_query`` (over ``id``) selects."""
    schema = "query_row long, query_id long, row long, vec_id long, score double"
    out = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    C.ship(spark)
    rows = C.with_row_id(usable(vectors, id_column, vector), "ann-rows", "row")
    coder = fit(rows)
    if coder is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("v") == len(coder.centre))
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    index = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "row", "id", "v")
    # a stated query set against all rows, in blocks: every block sees every query
    asks = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "row", "id", "v")
    dealt = index.unionByName(asks).repartition(blocks, "block").sortWithinPartitions("block", "asks")

    def run(batches):
        held, block, current = [], None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = table["block"].to_numpy() * 2 + table["asks"].to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                part = table.slice(a, b - a)
                number, asking = divmod(int(keys[a]), 2)
                if number != current:
                    held, block, current = [], None, number
                names, ids, x = part["row"].to_numpy(), part["id"].to_numpy(), _matrix(part["v"].combine_chunks())
                if not asking:
                    held.append((names, ids, x))
                    continue
                if not held:  # a block without rows of its own
                    continue
                if block is None:
                    block = Block(*(np.concatenate(h) for h in zip(*held)), coder)
                codes = coder.codes(x)
                asking_row, q, r, v, s = [], [], [], [], []
                for i in range(len(ids)):
                    found, near, dist = block.nearest(int(names[i]), x[i], codes[i], k)
                    asking_row.append(np.full(len(near), names[i]))
                    q.append(np.full(len(near), ids[i]))
                    r.append(found)
                    v.append(near)
                    s.append(dist)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in ((asking_row, pa.int64()), (q, pa.int64()), (r, pa.int64()), (v, pa.int64()), (s, pa.float64()))], ["query_row", "query_id", "row", "vec_id", "score"])

    found = dealt.mapInArrow(run, schema)
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth embedding."""
    return search(C.read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
