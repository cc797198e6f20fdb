"""Token counts by heap-and-linked-list byte-pair merging.

Every whole text is cut into the tokenizer's words in its scan task.  A word
begins as one symbol per UTF-8 byte; the symbols stand in a linked list and the
adjacent pairs that a merge rule knows wait in a heap.  The pair of the lowest
rank (the leftmost, if equal) is popped and merged until none is left, and

    tokens of a word = its symbols at first - merges done,

so no token identifier is ever made.  A word of ``n`` bytes costs ``n log n``,
also one of a million bytes without a blank.  A task remembers the counts of up
to ``REMEMBERED`` short words; the memory changes the speed only.  Nothing is
shuffled: one scan gives the result.

Defined cases: a null text counts as an empty one (0 bytes, 0 tokens); rows are
counted one by one, so repeated and null keys stay rows of their own; an empty
table gives no rows; only the key and the text are read, so further columns
with any names do no harm.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import common as C

#: Documents above this number of tokens are marked.
TOKEN_LIMIT = 1024
#: Words whose counts a task remembers at once, and the longest of them (in characters).
REMEMBERED, SHORT = 300_000, 64
#: Texts above so many characters are cut word by word instead of into one list.
LISTED = 1 << 20

#: Below this code point the character classes of all Unicode versions agree; texts with others are cut by the library itself.
SETTLED = 0x558


def _split(below: int) -> re.Pattern:
    """The split of the byte-level tokenizers for texts with code points under ``below``, the classes spelt out."""
    def members(kind: str) -> str:
        found = regex.compile(rf"\p{{{kind}}}")
        return "".join(re.escape(chr(c)) for c in range(below) if found.match(chr(c)))

    letter, number, space = members("L"), members("N"), members("White_Space")
    # Fixed value: the alternatives and their order
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_ASCII_WORDS, _WORDS = _split(0x80), _split(SETTLED)
_SETTLED = re.compile(f"[\x00-{chr(SETTLED - 1)}]*")

_loaded: dict[str, tuple[Callable[[str], Iterable[str]], Callable[[str], int]]] = {}


class Merges:
    """The merge rules of a tokenizer file: which pairs of symbols merge, in which order, into what.

    Symbols are numbered by their text; a pair is one integer.
    """

    def __init__(self, rules: list[tuple[str, str]], alphabet: list[str]):
        number = {symbol: k for k, symbol in enumerate(alphabet)}
        for left, right in rules:
            number.setdefault(left + right, len(number))
        self.first = [number[symbol] for symbol in alphabet]
        self.width = len(number)
        self.rank = {number[a] * self.width + number[b]: k for k, (a, b) in reversed(list(enumerate(rules)))}
        self.into = [number[a + b] for a, b in rules]

    def count(self, data: bytes) -> int:
        """Symbols that are left when no rule applies any more."""
        n = len(data)
        if n < 2:
            return n
        symbols = [self.first[b] for b in data]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # the linked list; n ends it
        rank, width, into = self.rank, self.width, self.into
        get, push, pop = rank.get, heapq.heappush, heapq.heappop
        # an entry is one integer: the rank, then the place of the pair's left symbol
        heap = [r * n + i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := get(a * width + b)) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = divmod(pop(heap), n)
            j = after[i]
            # an entry is stale once one of its symbols was merged: a merged-away place has the symbol -1
            if j >= n or symbols[i] < 0 or get(symbols[i] * width + symbols[j]) != r:
                continue
            merges += 1
            symbols[i], symbols[j] = into[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(symbols[i] * width + symbols[k])) is not None:
                    push(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := get(symbols[h] * width + symbols[i])) is not None:
                push(heap, r * n + h)
        return n - merges


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else the next of U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def load(path: str) -> tuple[Callable[[str], Iterable[str]], Callable[[str], int]]:
    """``(cut, count)`` of a byte-level BPE file: a text's words, and the tokens of a whole text (once per process)."""
    if path in _loaded:
        return _loaded[path]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
    marks = re.compile("|".join(map(re.escape, special))) if special else None
    merges = Merges(rules, byte_symbols())
    library = Tokenizer.from_file(path).pre_tokenizer
    known: dict[str, int] = {}

    def cut(text: str) -> Iterable[str]:
        if not _SETTLED.fullmatch(text):
            return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]
        words = _ASCII_WORDS if text.isascii() else _WORDS
        return words.findall(text) if len(text) <= LISTED else (m.group() for m in words.finditer(text))

    def count(text: str) -> int:
        total = 0
        pieces = [text]
        if marks:  # a special string inside a text is one token, as the library has it by default
            pieces = marks.split(text)
            total += len(pieces) - 1
        for piece in pieces:
            for word, times in Counter(cut(piece)).items():
                n = known.get(word)
                if n is None:
                    n = merges.count(word.encode())
                    if len(word) <= SHORT:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = n
                total += n * times
        return total

    _loaded[path] = cut, count
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, n_tokens)`` of every row; ``path``: a byte-level BPE tokenizer file."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        count = load(path)[1]
        tokens = [count(x) if x else 0 for x in batch.column(2).to_pylist()]
        return {key: batch.column(0), "n_bytes": batch.column(1), "n_tokens": pa.array(tokens, pa.int64())}

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("_key"), size.alias("_size"), F.col(text).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    return C.map_batches(rows, work, f"`{key}` {kind}, n_bytes long, n_tokens long")


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than ``TOKEN_LIMIT`` tokens."""
    counted = token_counts(C.read_table(spark, sf_dir, "documents"), public_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
