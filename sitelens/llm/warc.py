"""WARC archives: written as whole-file gzip streams, then normalised to one member per record.

1. ``write_archives``: one WARC/1.1 record per page.  Payloads of at least
   ``LEAST_BYTES`` that occur again are stored once; the others are ``revisit``
   records.  Spark's text writer puts each partition into one gzip stream.
2. ``normalise``: each archive is inflated once, as a stream; every record is
   written as a gzip member of its own, and a sidecar index (``.idx`` file, one
   JSON line per record) tells where it begins.  A task's files carry a name of
   their own and count only if listed in the returned index, so a task that is
   run again after the loss of an executor leaves nothing wrong behind.
3. ``read_back``: records are read by offset, one at a time, and their payload
   digests are computed anew.

Archives lie in the folder that ``spark.checkpoint.dir`` names, which every
executor reaches (``pyarrow.fs`` opens it); pages and archives are read by
Spark.

Defined cases: a null html is an empty payload; rows that repeat the largest
page_id of a payload are responses too; a null page_id counts as smallest; a
null url becomes ``urn:page:<id>``; white space in a url is percent-encoded; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import common as C

LEAST_BYTES = 1000
#: The records' date (a parameter of the run, so that reruns give the same archives).
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
STEP = 1 << 20

INDEX = "file string, offset long, length long, record_id string, record_type string, page_id long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``value``: the text of one record per page, up to the last line break."""
    html = C.text_or_empty("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"),
                        F.octet_length(html).cast("long").alias("bytes"))
    # partial sums first: a payload held by a third of all pages is one row per task
    again = (rows.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
             .where("n > 1").drop("n").withColumn("again", F.lit(True)))
    rows = rows.join(again, ["digest", "bytes"], "left")
    revisit = F.coalesce("again", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))

    def urn(of) -> F.Column:
        h = F.md5(F.concat_ws("/", F.lit("page"), of.cast("string"), "digest").cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))

    def header(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))

    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    parts = [
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), header("WARC-Record-ID", urn(F.col("page_id"))),
        header("WARC-Date", F.lit(date)), header("WARC-Target-URI", uri), header("Content-Type", F.lit("application/http;msgtype=response")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), header("X-Payload-Length", F.col("bytes")),
        F.coalesce(header("X-Page-ID", F.col("page_id")), F.lit("")),
        F.when(revisit, F.concat(header("WARC-Profile", F.lit(PROFILE)), header("WARC-Refers-To", urn(F.col("first"))), header("X-Refers-To-Page-ID", F.col("first")))).otherwise(F.lit("")),
        header("Content-Length", F.octet_length(block)), F.lit("\r\n"), block, F.lit("\r\n"),
    ]
    return rows.select(F.concat(*parts).alias("value"))


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """One whole-file gzip stream per partition (the line separator ends each record)."""
    records(pages, date).write.option("compression", "gzip").option("lineSep", "\r\n").text(folder)


def inflate(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file, a step at a time; members that follow one another are one stream."""
    stream, at = zlib.decompressobj(31), 0
    while at < len(content):
        out = stream.decompress(content[at:at + STEP])
        at += STEP
        while stream.eof and stream.unused_data:
            yield out
            rest = stream.unused_data
            stream = zlib.decompressobj(31)
            out = stream.decompress(rest)
        yield out
    yield stream.flush()


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])} | {"": lines[0]}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and the whole bytes of each record of a stream; one record is held at a time."""
    buffer = bytearray()

    def more() -> bool:
        for piece in pieces:
            if piece:
                buffer.extend(piece)
                return True
        return False

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if bytes(buffer).strip():
                    raise ValueError("the archive ends within a record's headers")
                return
        head = parse_head(bytes(buffer[:end]))
        if not head[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head[''][:40]!r}")
        size = end + 4 + int(head["content-length"]) + 4
        while len(buffer) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield head, bytes(buffer[:size])
        del buffer[:size]


def normalise(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Rewrite every archive of ``folder`` into ``out`` with one member per record; the index as a written table."""
    C.ship(spark)

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name = path.as_py().rsplit("/", 1)[-1].split(".")[0] + f"-{uuid.uuid4().hex}.warc.gz"
                store, root = fs.FileSystem.from_uri(out)
                rows, at = [], 0
                with store.open_output_stream(f"{root}/{name}", compression=None) as file:
                    for head, record in split_records(inflate(content.as_py())):
                        member = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = member.compress(record) + member.flush()
                        file.write(data)
                        page = head.get("x-page-id")
                        rows.append((name, at, len(data), head["warc-record-id"], head["warc-type"], int(page) if page is not None else None))
                        at += len(data)
                names = [f.split()[0] for f in INDEX.split(", ")]
                with store.open_output_stream(f"{root}/{name}.idx", compression=None) as side:
                    for row in rows:
                        side.write((json.dumps(dict(zip(names, row))) + "\n").encode())
                if rows:
                    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    _make_folder(out)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    return C.write_once(files.mapInArrow(run, INDEX), "warc-index")


def _make_folder(uri: str) -> None:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)


def read_back(index: DataFrame, out: str) -> DataFrame:
    """``RECORDS`` rows, from each record's own member at its offset; a digest that does not match is an error."""
    C.ship(index.sparkSession)

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        opened, file = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if name != opened:
                    if file is not None:
                        file.close()
                    opened, file = name, store.open_input_file(f"{root}/{name}")
                file.seek(offset)
                rows.append(_record(zlib.decompress(file.read(length), 31)))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [f.split()[0] for f in RECORDS.split(", ")])

    return index.select("file", "offset", "length").sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)


def _record(data: bytes) -> tuple:
    head_end = data.index(b"\r\n\r\n")
    head = parse_head(data[:head_end])
    block = data[head_end + 4:head_end + 4 + int(head["content-length"])]
    payload = block[block.index(b"\r\n\r\n") + 4:]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    size = int(head["x-payload-length"])
    if head["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
    return int(page) if page is not None else None, size, digest, head["warc-type"], int(refers) if refers is not None else None


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write, normalise and read back; archives and sidecars stay under ``folder``."""
    write_archives(pages, f"{folder}/whole")
    index = normalise(pages.sparkSession, f"{folder}/whole", f"{folder}/members")
    return read_back(index, f"{folder}/members")


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold."""
    root = C.ensure_checkpoint_dir(spark).rstrip("/")
    return archive_pages(C.read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{root}/warc-{uuid.uuid4().hex}")
