"""What the operators of this subpackage share: shipping code, written tables, free column names."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.session import drop_materialized, ensure_checkpoint_dir, materialize, read_table, run_scope  # noqa: F401

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch on its way to a Python worker, unless the session names another number.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))

#: Rows that a Parquet reader holds at once, unless the session names another number: they carry whole texts, and a
#: batch of Spark's 4,096 rows takes tens of MB of an executor's heap per task.
READ_ROWS = ("spark.sql.parquet.columnarReaderBatchSize", "512")

#: Rows of numbers that a join may broadcast (a few MB).
BROADCAST_ROWS = 100_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers (once per application), and bound what they get and readers hold."""
    for name, value in (BATCH_BYTES, READ_ROWS):
        if name not in spark.conf.getAll:
            spark.conf.set(name, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="sitelens-code-"), "sitelens_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def give_back() -> None:
    """Hand memory that a batch no longer needs back to the system: a worker lives on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others do without
    if trim:
        trim(0)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str) -> DataFrame:
    """``mapInArrow`` with one dictionary of columns per input batch."""
    ship(df.sparkSession)
    kind = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    names = kind.fieldNames()
    types = [arrow_type(f.dataType) for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([_fit(made[n], t) for n, t in zip(names, types)], names)
                    made = None
                give_back()

    return df.mapInArrow(run, schema)


def _fit(column: pa.Array, kind: pa.DataType) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if column.type == kind else column.cast(kind)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: cut lineage, fixed row order and ids."""
    return materialize(df, f"llm-{name}")


def settled(make: Callable[[], DataFrame], name: str, spark: SparkSession) -> DataFrame:
    """What ``make`` returns, written once; the tables written on the way to it are deleted then, so that they do not
    lie beside those of the steps that follow."""
    run = uuid.uuid4().hex
    try:
        with run_scope(run):
            made = make()
        return write_once(made, name)
    finally:
        drop_materialized(spark, run)


def slim(df: DataFrame, name: str) -> DataFrame:
    """A side of a few numbers a row and unique keys, for a join with rows that carry whole texts: written once, sent to
    every task up to ``BROADCAST_ROWS`` rows; beyond that it is shuffled and hashed, so that no text is ever sorted."""
    held = write_once(df, name)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held.hint("shuffle_hash")


def with_row_id(df: DataFrame, name: str, out: str = "rid") -> DataFrame:
    """``df`` written with a row number of its own (unique, not gapless), for tables whose ids may repeat or be null."""
    return write_once(df.withColumn(out, F.monotonically_increasing_id()), name)


def numbered(df: DataFrame, group: str, order: list[str], out: str, name: str) -> DataFrame:
    """0-based places within ``group`` by ``order``, for groups of any size: ranges of rows are numbered
    apart and shifted by the counts before them.  Rows that are alike in ``order`` may swap places."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, group, *order, "_tie")
              .sortWithinPartitions(group, *order, "_tie").drop("_tie")
              .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    ranged = write_once(ranged, name)  # both uses below must see the same places
    counts = ranged.groupBy("_pid", group).agg(F.min("_mid").alias("_m0"), F.count("*").alias("_c"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return ranged.join(shifts, ["_pid", group]).withColumn(out, F.col("_off") + F.col("_mid") - F.col("_m0")).drop("_pid", "_mid", "_m0", "_off")


def hashed_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key`` (equal keys count once).

    Twice as many as asked are let through by a bound on the hash, set from the number of rows, so a task hands on
    its share of the sample and not a whole sample.
    """
    span = 1 << 40
    most = min(span, 2 * rows * span // max(1, df.count()) + 1)
    hashed = df.withColumn("_hash", F.pmod(F.xxhash64(key, F.lit(9)), F.lit(span))).where(F.col("_hash") < most)
    return hashed.dropDuplicates(["_hash"]).orderBy("_hash").limit(rows).drop("_hash")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")
