"""Row numbers and ``lead`` within a group, without a per-group task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` puts a whole group in one
task; a group holding a third of all rows would be one task.  Here the rows
are range-partitioned on (g, o), so a hot group spans many partitions; each
partition numbers its rows in order, and a small table of per-(partition,
group) counts gives each partition's offset within its group (a window over
at most #partitions rows per group).  ``lead`` becomes an equi-join on
(g, ordinal + k), whose keys are all distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.session import materialize


def with_ordinal(df: DataFrame, group: str, order: str, out: str = "ordinal") -> DataFrame:
    """Add ``out`` = 0-based position of the row within ``group`` by ``order`` (``order`` unique per group)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, group, order).sortWithinPartitions(group, order)
              .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    # written once: both uses below must see the same partition ids and positions
    ranged = materialize(ranged, "ordinal")
    counts = ranged.groupBy("_pid", group).agg(F.min("_mid").alias("_m0"), F.count("*").alias("_c"))
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    out_col = (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("bigint").alias(out)
    return ranged.join(offsets, ["_pid", group]).select(*df.columns, out_col)


def with_lead(df: DataFrame, group: str, ordinal: str, value: str, k: int, out: str) -> DataFrame:
    """Add ``out`` = ``value`` of the row ``k`` places later in the group (null past the end)."""
    later = df.select(group, (F.col(ordinal) - k).alias(ordinal), F.col(value).alias(out))
    return df.join(later, [group, ordinal], "left")
