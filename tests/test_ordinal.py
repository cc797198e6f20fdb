"""Skew-safe ordinals equal row_number()/lead() even when one group holds a third of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelens.operators.ordinal import with_lead, with_ordinal


def test_ordinal_and_lead_match_window(spark):
    n = 3000
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 97}", f"/p{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, g string, path string").repartition(5)
    got = with_lead(with_ordinal(df, "g", "id", "ord"), "g", "ord", "path", 2, "nxt2")
    w = Window.partitionBy("g").orderBy("id")
    want = df.select("id", (F.row_number().over(w) - 1).alias("ord"), F.lead("path", 2).over(w).alias("nxt2"))
    a = sorted(tuple(r) for r in got.select("id", "ord", "nxt2").collect())
    b = sorted(tuple(r) for r in want.collect())
    assert a == b
    ranged = df.repartitionByRange(8, "g", "id").where("g = 'hot'")  # as the helper deals rows out
    assert ranged.select(F.spark_partition_id()).distinct().count() > 1 and got.where("g = 'hot'").count() == n // 3
