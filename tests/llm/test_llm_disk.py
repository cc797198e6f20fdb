"""What the operators leave in the checkpoint folder."""

import glob
import os

import pyarrow.parquet as pq

from sitelens.llm import common as C
from sitelens.llm import near_dedup, passages
from sitelens.session import ensure_checkpoint_dir


def tables(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {os.path.basename(x) for x in glob.glob(f"{folder}/llm-*")}


def test_near_dedup_leaves_its_classes_alone(spark):
    docs = spark.createDataFrame([(k, f"{'one text of some words ' * 9} {k % 3}") for k in range(30)], "doc_id long, text string")
    before = tables(spark)
    got = near_dedup.near_duplicate_classes(docs)
    left = tables(spark) - before
    assert {x.rsplit("-", 1)[0] for x in left} == {"llm-near-classes"}
    assert got.count() == 30 and got.where("kept").count() == got.select("class_id").distinct().count()  # it can be read without the others


def test_passages_leave_no_units_windows_or_sets(spark):
    part = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"{k} {part} {'x' * k}") for k in range(1, 6)] + [(None, part), (2, f"2 {part} xx")], "doc_id long, text string")
    before = tables(spark)
    got = passages.repeated_passages(docs).collect()
    left = {x.rsplit("-", 1)[0] for x in tables(spark) - before}
    assert not left & {f"llm-{x}" for x in ("passages-units", "passages-sets", "passages-seeds", "passages-windows", "links-keys", "cc-labels")}
    assert {r["doc_id"] for r in got if r["kind"] == "passage"} == {1, 2, 3, 4, 5, None}


def test_a_failed_step_leaves_nothing_of_its_own(spark):
    before = tables(spark)

    def broken():
        C.write_once(spark.range(3), "broken-part")
        raise ValueError("no")

    try:
        C.settled(broken, "broken", spark)
    except ValueError:
        pass
    else:
        raise AssertionError("the error is hidden")
    assert tables(spark) == before


def test_written_tables_are_packed_closely(spark):
    held = C.write_once(spark.createDataFrame([(1, "words " * 100)], "id long, text string"), "packed-closely")
    files = [pq.ParquetFile(x.removeprefix("file://")).metadata for x in held.inputFiles()]
    assert {f.row_group(0).column(1).compression for f in files if f.num_rows} == {"ZSTD"}


def test_readers_hold_few_whole_texts_unless_the_session_says_otherwise(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    try:
        spark.conf.unset(name)
        near_dedup.signed_documents(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
        assert int(spark.conf.get(name)) <= 512
        spark.conf.set(name, "2048")
        C.ship(spark)
        assert spark.conf.get(name) == "2048"
    finally:
        spark.conf.unset(name)
