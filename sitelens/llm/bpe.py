"""BPE encoding and decoding through a table of distinct words.

1. Every text is split in its scan task; a task lists each of its words once.
2. The lists meet in one table of distinct words, and each word is encoded
   once there, by the public tokenizer itself.
3. Ids become pieces by a join with the vocabulary (id, piece), whose size is
   bounded by the tokenizer file.
4. The encoded words go back to the block of rows they came from, where ids and
   pieces are put together by the words' positions in each text.

Only distinct words per block and the positions are shuffled, never a row per
word occurrence: a text travels as the numbers of its words in its part of the
block, about 1.5 bytes a word.  A block is one input split, so its size is
bounded by the reader's split size.

A *word* here is the smallest part the tokenizer treats alone: texts are cut at
white space (the normaliser drops it), lower-cased and cut by the tokenizer's
own pre-tokenizer.  Text that normalises differently when cut, or that holds a
special token, stays whole as one word, so the result always equals encoding
the whole text.

Defined cases: a null text is an empty one (no tokens, the digests of the empty
string); repeated and null ids are encoded row by row; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm import common as C

#: A task hands on its list of words whenever it holds so many, and starts a new one.
WORDS_AT_ONCE = 1_000_000
#: Places of words (a word in a block) that are packed at once, about.
PLACES_AT_ONCE = 500_000

_ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
# Latin letters with marks: already composed, and lower-cased one by one (the dotted capital I and the two
# spaces of this range are left to the general way).
_LATIN = re.compile("[\x00-\x84\x86-\x9f\xa1-\u012f\u0131-\u017f]*")
_LATIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Bytes of text that are numbered together, about.
PART_BYTES = 8 << 20
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process, without truncation, padding or threads of its own."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _loaded:
        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _loaded[path] = made
    return _loaded[path]


def splitter(path: str) -> Callable[[bytes], list[bytes]]:
    """Cuts a run without white space into the tokenizer's words."""
    tok = tokenizer(path)
    special = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
    letters = not any(s.isalpha() for s in special)

    def cut(run: bytes) -> list[bytes]:
        if letters and run.isalpha():  # ASCII letters alone are one word
            return [run.lower()]
        if any(s in run for s in special):
            return [run]
        if run.isascii():
            return _ASCII_PARTS.findall(run.lower())
        text = run.decode()
        if _LATIN.fullmatch(text):
            return [p.encode() for p in _LATIN_PARTS.findall(text.lower())]
        plain = tok.normalizer.normalize_str(text)
        parts = [plain[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(plain)]
        for part in parts:
            if tok.normalizer.normalize_str(part) != part or len(tok.pre_tokenizer.pre_tokenize_str(part)) != 1:
                return [run]
        return [p.encode() for p in parts]

    return cut


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _runs(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many runs between white space each text has, and all runs in order, dictionary-encoded."""
    lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    flat = lists.flatten()
    real = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(column)), np.asarray(pc.list_value_length(lists)))[real.to_numpy(zero_copy_only=False)]
    return np.bincount(owner, minlength=len(column)), flat.filter(real).dictionary_encode()


def _parts(column: pa.Array):
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()))
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PART_BYTES)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``PART_BYTES`` (whole texts)."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > PART_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def block_words(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``(block, word)``: the words of each block, once per task (or part of a task)."""
    C.ship(docs.sparkSession)

    def run(batches):
        cut, runs, words, block = splitter(path), set(), set(), None

        def out():
            listed = list(words)
            for a in range(0, len(listed), 50_000):
                part = listed[a:a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int32()), pa.array(part, pa.binary())], ["block", "word"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0)[0].as_py()
            for a, b in _parts(batch.column(1)):
                new = set(_utf8(_runs(batch.column(1).slice(a, b - a))[1].dictionary)) - runs
                C.give_back()
                runs |= new
                for r in new:
                    words.update(cut(r))
                if len(runs) >= WORDS_AT_ONCE:
                    yield from out()
                    runs, words = set(), set()
        if words:
            yield from out()

    marked = docs.select(F.spark_partition_id().alias("block"), F.col(text).alias("text"))
    return marked.mapInArrow(run, "block int, word binary")


def block_positions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(block, packed)``: keys of a part of a block, its distinct runs, and each text as the numbers of its runs."""
    C.ship(docs.sparkSession)

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in _gathered(batches):
            for a, b in _parts(batch.column(2)):
                counts, runs = _runs(batch.column(2).slice(a, b - a))
                codes = runs.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(-np.bincount(codes, minlength=len(runs.dictionary)), kind="stable")  # frequent runs get small numbers
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                planes = rank[codes].view(np.uint8).reshape(-1, 4).T.tobytes() if len(codes) else b""
                sink = pa.BufferOutputStream()
                streams = ({"key": batch.column(1).slice(a, b - a), "n": pa.array(counts, pa.int64())}, {"run": runs.dictionary.take(pa.array(order))}, {"planes": pa.array([planes], pa.large_binary())})
                for columns in streams:
                    made = pa.table(columns)
                    with pa.ipc.new_stream(sink, made.schema, options=options) as writer:
                        writer.write_table(made)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "packed"])
                C.give_back()

    marked = docs.select(F.spark_partition_id().alias("block"), F.col(key).alias("key"), F.col(text).alias("text"))
    return marked.mapInArrow(run, "block int, packed binary")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(block, packed)``: words with their blocks as one compressed Arrow stream per block, whenever
    ``PLACES_AT_ONCE`` places are held."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table["blocks"].combine_chunks()
        flat, owner = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy()
        order = np.argsort(flat, kind="stable")
        flat, owner, table = flat[order], owner[order], table.drop_columns(["blocks"])
        edges = [0, *(np.flatnonzero(flat[1:] != flat[:-1]) + 1).tolist(), len(flat)]
        packed = []
        for a, b in zip(edges[:-1], edges[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
                writer.write_table(table.take(pa.array(owner[a:b])).combine_chunks())
            packed.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(flat[edges[:-1]], pa.int32()), pa.array(packed, pa.binary())], ["block", "packed"])

    held, places = [], 0
    for batch in batches:
        held.append(batch)
        places += len(batch.column("blocks").flatten())
        if places >= PLACES_AT_ONCE:
            yield out(held)
            held, places = [], 0
            C.give_back()
    if held:
        yield out(held)
        held = []
        C.give_back()


def joined(values: pa.Array, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Consecutive ``values`` up to each of ``ends``, joined by spaces (no values: empty)."""
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int64()), values.cast(pa.large_binary()))
    return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))


def _whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, blocks, ids_text, pieces_text)`` for the rows ``(word, blocks, n, at, id, piece)`` of words, a row per id
    in order; the rows of a word may lie in several batches."""
    held: list[pa.RecordBatch] = []
    missing = 0  # rows of the last word still to come
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if batch.num_rows < missing:  # a word longer than a batch
            missing -= batch.num_rows
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        at = rows.column("at").to_numpy()
        heads = np.flatnonzero(at == 0)
        sizes = rows.column("n").to_numpy()[heads].astype(np.int64)
        ends = np.cumsum(sizes)
        if not len(heads) or (heads != ends - sizes).any() or (at != np.arange(len(at)) - np.repeat(heads, np.diff([*heads, len(at)]))).any():
            raise ValueError("the rows of a word are out of order")
        missing = int(ends[-1]) - len(at)
        if missing < 0:
            raise ValueError("the rows of a word are out of order")
        if missing:
            heads, ends = heads[:-1], ends[:-1]
        done = int(ends[-1]) if len(ends) else 0
        held = [rows.slice(done)] if missing else []
        if done:
            texts = [joined(rows.column(c).slice(0, done).cast(pa.string()), ends).cast(pa.large_string()).cast(pa.string()) for c in ("id", "piece")]
            first = pa.array(heads)
            yield pa.RecordBatch.from_arrays([rows.column("word").take(first), rows.column("blocks").take(first), *texts], ["word", "blocks", "ids_text", "pieces_text"])
    if missing:
        raise ValueError("the rows of a word are out of order")


def _digests(texts: pa.LargeBinaryArray) -> pa.Array:
    """SHA-256 of every text, read where it lies."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1].tolist()
    data = memoryview(texts.buffers()[2] or b"")
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string())


def unpack(column: pa.ChunkedArray) -> list[pa.Table]:
    return [pa.ipc.open_stream(p).read_all() for p in column.to_pylist()]


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(id, piece)`` of every id of the tokenizer file, special tokens included."""
    pairs = sorted((i, p) for p, i in tokenizer(path).get_vocab(with_added_tokens=True).items())
    return spark.createDataFrame(pairs, T.StructType([T.StructField("id", T.IntegerType()), T.StructField("piece", T.StringType())]))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``(word, ids)`` for a table of distinct words."""
    C.ship(words.sparkSession)

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        tok = tokenizer(path)
        made = tok.encode_batch([w.decode() for w in _utf8(column)], add_special_tokens=False)
        out = pa.array([e.ids for e in made], pa.list_(pa.int32()))
        made = None
        C.give_back()
        return out

    return words.withColumn("ids", encode.asNondeterministic()(F.col("word")))


def decode_ids(encoded: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``(block, packed)`` for ``(word, blocks, ids)``: each block's words with their decimal ids (``ids_text``) and
    pieces (``pieces_text``), joined by spaces in order, as compressed Arrow streams.

    The ids of a word become consecutive rows, the join with the vocabulary (broadcast: bounded by the tokenizer
    file) keeps their order, and the rows of a word are put together again as they come by - no shuffle.  The same
    worker packs the words by block: a second one beside it would only take memory.
    """
    C.ship(spark)
    head = F.col("at") == 0
    placed = (encoded.select("word", "blocks", F.size("ids").alias("n"), F.posexplode("ids").alias("at", "id")).join(F.broadcast(vocabulary(spark, path)), "id")
              .select(F.when(head, F.col("word")).alias("word"), F.when(head, F.col("blocks")).alias("blocks"), "n", "at", "id", "piece"))

    return placed.mapInArrow(lambda batches: _by_block(_whole_words(batches)), "block int, packed binary")


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``n_tokens``, and the ids and the decoded text as SHA-256 digests."""
    return _put_together(docs, path, key, text, digests=True)


def tokens_of(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``ids_text`` (decimal ids joined by spaces) and ``decoded`` — the operator's real output."""
    return _put_together(docs, path, key, text, digests=False)


def _put_together(docs: DataFrame, path: str, key: str, text: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    C.ship(spark)
    # one row per distinct word, with the blocks (input splits) that hold it
    words = block_words(docs, path, text).groupBy("word").agg(F.collect_list("block").alias("blocks"))
    back = decode_ids(encode_words(words, path), spark, path)
    rows = block_positions(docs, key, text)
    kind = docs.schema[key].dataType
    left_key = C.arrow_type(kind)
    out = "key {}, n_tokens long, ids string, decoded string".format(kind.simpleString())

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        cut, tok = splitter(path), tokenizer(path)
        known = {}
        for words in unpack(right["packed"]):
            known.update(zip(*(_utf8(words["word"].combine_chunks()), zip(*(_utf8(words[c].combine_chunks()) for c in ("ids_text", "pieces_text"))))))

        def whole(run: bytes) -> tuple[bytes, bytes]:
            """Ids and pieces of a run, put together from its words."""
            if run in known:  # a word of the table is its own only word
                return known[run]
            found = []
            for w in cut(run):
                if w not in known:  # the word has no ids, or the rows were split anew after a loss of executors
                    ids = tok.encode(w.decode(), add_special_tokens=False).ids
                    known[w] = (" ".join(map(str, ids)).encode(), " ".join(map(tok.id_to_token, ids)).encode())
                if known[w][0]:
                    found.append(known[w])
            return b" ".join([x[0] for x in found]), b" ".join([x[1] for x in found])

        keys, n, ids, decoded = [], [], [], []
        C.give_back()
        for part in left["packed"].to_pylist():
            source = pa.BufferReader(part)
            rows_, runs_, codes_ = (pa.ipc.open_stream(source).read_all() for _ in range(3))
            keys += rows_["key"].chunks
            made = [whole(r) for r in _utf8(runs_["run"].combine_chunks())]
            texts_of = [pa.array([m[k] for m in made], pa.large_binary()) for k in (0, 1)]
            tokens = np.array([m[0].count(b" ") + 1 if m[0] else 0 for m in made], np.int64)
            made = None
            codes = np.ascontiguousarray(np.frombuffer(codes_["planes"][0].as_py(), np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]
            ends = np.cumsum(rows_["n"].to_numpy())
            sizes = tokens[codes]
            n.append(np.diff(np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))]))
            if not sizes.all():  # runs without a token leave no gap
                codes, ends = codes[sizes > 0], np.concatenate(([0], np.cumsum(sizes > 0)))[ends]
            for texts, out_ in zip(texts_of, (ids, decoded)):
                text_ = joined(texts.take(pa.array(codes)), ends)
                out_ += [_digests(text_)] if digests else pa.chunked_array([text_]).cast(pa.large_string()).cast(pa.string()).chunks
        return pa.table({"key": pa.chunked_array(keys, type=left_key), "n_tokens": pa.array(np.concatenate([np.zeros(0, np.int64), *n]), pa.int64()),
                         "ids": pa.chunked_array(ids, pa.string()), "decoded": pa.chunked_array(decoded, pa.string())})

    made = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(join, out)
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids_text", "decoded")
    return made.select(F.col("key").alias(key), "n_tokens", F.col("ids").alias(names[0]), F.col("decoded").alias(names[1]))


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and digests of every document."""
    return encode_documents(C.read_table(spark, sf_dir, "documents"), public_path())
