"""Packed texts: many small texts in few files, with an offset index and a committed manifest (a Spark data source).

``df.write.format("packed_texts").mode("overwrite").save(path)`` puts the text
column of all rows of a task behind one another into bundles, and the other
columns with each text's offset and length into an index beside the bundle.  A
table of a million style sheets or reports is a few files per task.

* A task that ends hands the names of its bundles to the driver; the job's
  commit writes them into ``_manifest.json`` in one move.  Readers see the
  bundles of the manifest only, so a task that ran twice, a lost executor or a
  job that failed leaves nothing that could be read, and a rerun that overwrites
  replaces all earlier texts at once.  ``vacuum`` deletes files that no manifest
  names.
* A reader's partition is a byte range of a bundle: it holds the texts that
  begin in the range, and reads their bytes only.

The module is shipped to the workers by value and needs nothing of the package.
Paths are anything that ``pyarrow.fs`` opens (local, HDFS, object stores); they
must be shared by all executors.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

MANIFEST = "_manifest.json"
#: A bundle is closed beyond so many bytes; a reader's partition begins every so many bytes; bytes of texts read at once.
BUNDLE_BYTES, RANGE_BYTES, BATCH_BYTES = 256 << 20, 64 << 20, 8 << 20
#: Columns of an index besides the keys, and the column that says where a text was read.
OFFSET, SIZE, PLACE = "_offset", "_size", "packed_path"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _manifest(path: str) -> dict:
    system, root = _open(path)
    with system.open_input_stream(f"{root}/{MANIFEST}") as file:
        return json.loads(file.read())


@dataclass
class Written(WriterCommitMessage):
    bundles: list


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.text = options["path"], options.get("textcolumn", "text")
        self.overwrite, self.schema = overwrite, schema
        self.limit = int(options.get("bundlebytes", BUNDLE_BYTES))
        if self.text not in schema.fieldNames() or schema[self.text].dataType != StringType():
            raise ValueError(f"packed_texts needs a string column {self.text}")

    def write(self, iterator) -> Written:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        done, name, file, size, index = [], None, None, 0, []

        def close():
            nonlocal name, file, size, index
            if file is not None:
                file.close()
                with system.open_output_stream(f"{root}/{name}.index") as out:
                    pq.write_table(pa.Table.from_batches(index), out)
                done.append([name, size])
            name, file, size, index = None, None, 0, []

        for batch in iterator:
            column = batch.column(batch.schema.get_field_index(self.text)).cast(pa.large_string())
            sizes = pc.binary_length(column)
            lengths = pc.fill_null(sizes, 0).cast(pa.int64())
            if file is None:
                name = f"bundle-{uuid.uuid4().hex}"
                file = system.open_output_stream(f"{root}/{name}.texts", compression=None)
            ends = pc.cumulative_sum(lengths)
            rest = [c for c in batch.schema.names if c != self.text]
            index.append(pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in rest], pc.add(pc.subtract(ends, lengths), size), sizes.cast(pa.int64())], [*rest, OFFSET, SIZE]))
            offsets, data = column.buffers()[1], column.buffers()[2]
            if data is not None and len(column):
                import numpy as np

                at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
                file.write(data.slice(int(at[0]), int(at[-1] - at[0])))
                size += int(at[-1] - at[0])
            if size >= self.limit:
                close()
        close()
        return Written(done)

    def commit(self, messages) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        bundles = [b for m in messages if m is not None for b in m.bundles]
        if not self.overwrite:
            try:
                bundles = _manifest(self.path)["bundles"] + bundles
            except FileNotFoundError:
                pass
        told = {"schema": self.schema.json(), "text": self.text, "bundles": bundles}
        new = f"{root}/{MANIFEST}-{uuid.uuid4().hex}"
        with system.open_output_stream(new) as out:
            out.write(json.dumps(told).encode())
        system.move(new, f"{root}/{MANIFEST}")

    def abort(self, messages) -> None:
        system, root = _open(self.path)
        for m in messages:
            for name, _ in m.bundles if m is not None else ():
                for kind in ("texts", "index"):
                    system.delete_file(f"{root}/{name}.{kind}")


@dataclass
class ByteRange(InputPartition):
    bundle: str
    begin: int
    end: int


class PackedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.range = int(options.get("rangebytes", RANGE_BYTES))
        self.text = _manifest(self.path)["text"]

    def partitions(self) -> list[ByteRange]:
        ranges = []
        for name, size in _manifest(self.path)["bundles"]:
            # the last range is open: texts without bytes may stand at the very end
            starts = list(range(0, max(size, 1), self.range))
            ranges += [ByteRange(name, a, b) for a, b in zip(starts, [*starts[1:], 1 << 62])]
        return ranges

    def read(self, partition: ByteRange):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        if partition is None:  # an empty manifest
            return
        system, root = _open(self.path)
        with system.open_input_file(f"{root}/{partition.bundle}.index") as file:
            index = pq.read_table(file, filters=(pc.field(OFFSET) >= partition.begin) & (pc.field(OFFSET) < partition.end)).combine_chunks()
        begin = index[OFFSET].to_numpy()
        sizes = index[SIZE].combine_chunks()
        end = begin + pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff((begin - (begin[0] if len(begin) else 0)) // BATCH_BYTES)) + 1
        with system.open_input_file(f"{root}/{partition.bundle}.texts") as file:
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(begin)]):
                if a == b:
                    continue
                data = file.read_at(int(end[b - 1] - begin[a]), int(begin[a]))
                offsets = np.append(begin[a:b], end[b - 1]) - begin[a]
                texts = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)])
                texts = pc.if_else(pc.is_null(sizes.slice(a, b - a)), pa.scalar(None, pa.large_string()), texts).cast(pa.string())
                place = pa.array([f"{self.path}/{partition.bundle}.texts#{o}" for o in begin[a:b].tolist()], pa.string())
                part = index.slice(a, b - a)
                given = {self.text: texts, PLACE: place}
                yield pa.RecordBatch.from_arrays([given[f] if f in given else part[f].combine_chunks() for f in self.schema.fieldNames()], self.schema.fieldNames())


class PackedTexts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_texts"

    def schema(self) -> StructType:
        return StructType([*StructType.fromJson(json.loads(_manifest(self.options["path"])["schema"])).fields, StructField(PLACE, StringType())])

    def reader(self, schema: StructType) -> PackedReader:
        return PackedReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


def write_packed(df: DataFrame, path: str, text: str = "text", mode: str = "overwrite") -> None:
    """``df`` (the string column ``text`` and its keys) as packed texts."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df.sparkSession.dataSource.register(PackedTexts)
    df.write.format("packed_texts").option("path", path).option("textColumn", text).mode(mode).save()


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The keys, the text, and ``packed_path`` (bundle and offset) of every text of the manifest."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(PackedTexts)
    return spark.read.format("packed_texts").option("path", path).load()


def vacuum(path: str) -> int:
    """Delete the files of failed or replaced writes, which no manifest names; how many.  Not while a write is running."""
    from pyarrow import fs

    system, root = _open(path)
    named = {f"{name}.{kind}" for name, _ in _manifest(path)["bundles"] for kind in ("texts", "index")}
    stale = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name not in named and f.base_name.startswith(("bundle-", f"{MANIFEST}-"))]
    for file in stale:
        system.delete_file(file)
    return len(stale)
