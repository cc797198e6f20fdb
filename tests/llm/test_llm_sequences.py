"""Periodic runs, ranked search and token counts against brute-force versions, the library and SQL."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from conftest import SF001

from sitelens.llm import periodic_runs as R
from sitelens.llm import stratified_index as X
from sitelens.llm import token_counts as TC
from sitelens.llm.catalog import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, n_runs string, rank int, n string, terms int, _text string"


def odd_docs(spark, texts):
    """Rows with null and repeated ids, null texts, and columns named as the operators' own."""
    rows = [(k if k != 3 else None, t, "x", 7, "n", 1, "y") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]], DOCS)


# ---------------------------------------------------------------- runs


def plain_runs(w, least=2, periods=2):
    out = []
    for q in range(1, len(w) // periods + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, periods * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    rnd = random.Random(5)
    for k in range(1200):
        w = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randint(0, 30))]
        if k % 3 == 0:
            w = (w[:rnd.randint(1, 5)] * 10)[:rnd.randint(1, 30)] + w
        assert sorted(map(tuple, R.runs_of(np.array(w, np.int64)).tolist()), key=lambda r: (r[0], r[2])) == plain_runs(w)


def test_long_runs_of_many_texts():
    rnd = random.Random(6)
    for _ in range(120):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            w = [rnd.randrange(rnd.choice([2, 5, 1000])) for _ in range(rnd.randint(0, 40))]
            for _ in range(rnd.randint(0, 3)):
                root = [rnd.randrange(rnd.choice([2, 9, 1000])) for _ in range(rnd.randint(1, 20))]
                w += (root * 40)[:rnd.randint(10, 90)] + [rnd.randrange(1000) for _ in range(rnd.randint(0, 5))]
            texts.append(w)
        offsets = np.cumsum([0, *map(len, texts)])
        got = R.long_runs(np.array([x for t in texts for x in t], np.int64), offsets)
        assert [tuple(r) for r in got.tolist()] == [(t, *r) for t, w in enumerate(texts) for r in plain_runs(w, 24, 3)]


def test_extensions():
    rnd = random.Random(7)
    s = np.array([rnd.randrange(3) for _ in range(200)] + [3])
    lce = R.Extensions(s)
    a, b = np.array([(i, j) for i in range(201) for j in range(201) if i != j]).T
    want = [next(k for k in range(202) if x + k > 200 or y + k > 200 or s[x + k] != s[y + k]) for x, y in zip(a.tolist(), b.tolist())]
    assert lce(a, b).tolist() == want


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w, 24, 3)
    gone = {x for a, size, q in runs for x in range(a + q, a + size)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_periodic_runs_query(spark, tmp_path):
    rnd = random.Random(8)
    texts = [None, "", " \t\n ", "a " * 400, "é ß　ö " * 30, *(" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 120))) for _ in range(150)),
             "\n".join(["the same line of seven words again"] * 5), " ".join(map(str, range(30))) + " x y" * 12]
    docs = odd_docs(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    want = [plain_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert any(r[1] and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in want)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op11_periodic_runs"](spark, f"{tmp_path}/none").count() == 0


def test_collapse_gives_texts(spark):
    docs = spark.createDataFrame([(1, "x " + "a b " * 20 + "y")], "k int, t string")
    row = R.collapse_runs(docs, "k", "t").first()
    assert (row["n_words"], row["collapsed"], [tuple(r) for r in row["runs"]]) == (42, "x a b y", [(1, 40, 2)])


# ---------------------------------------------------------------- search


def sql_rows(folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    rel = con.sql(ORACLE_SQL["op12_lexical_search"])
    return sorted(rel.fetchall())


@pytest.mark.parametrize("block", [50_000, 7])
def test_search_against_sql(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_DOCS", block)
    rnd = random.Random(9)
    words = ["alpha", "Beta", "GAMMA", "été", "İx", "x1", "zéro", "w", "中文", "q-q", "don't"]
    texts = [None, "", "...", "alpha", "alpha", "ALPHA alpha", *(rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(300))]
    spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, item string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "alpha beta beta"), (2, "ÉTÉ été x1"), (3, None), (4, ""), (5, "nowhere"), (6, " ".join(words * 3)), (7, "q")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in QUERIES["op12_lexical_search"](spark, str(tmp_path)).select("item_id", "rank", "doc_id", "score").collect()]
    want = sql_rows(tmp_path)
    assert len(want) > 60 and sorted(got) == want


def test_search_groups_and_odd_rows(spark, monkeypatch):
    docs = odd_docs(spark, ["a b c", "a", None, "a b", "b c d"])
    items = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "d")], "item_id long, text string")
    whole = sorted(map(str, X.ranked_search(docs, items).collect()))
    assert len(whole) == 2 * 5 + 1 and sum("doc_id=None" in r for r in whole) == 2
    monkeypatch.setattr(X, "ITEM_BYTES", 3)
    assert sorted(map(str, X.ranked_search(docs, items).collect())) == whole
    assert X.ranked_search(docs.limit(0), items).count() == 0 and X.ranked_search(docs, items.limit(0)).count() == 0


# ---------------------------------------------------------------- tokens


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TC.public_path())


def test_token_counts_of_random_texts():
    tok, count = library(), TC.load(TC.public_path())[1]
    rnd = random.Random(10)
    pool = [chr(c) for c in range(0x20, 0x7F)] + list("\n\t\r\x0b\x1c\x1d\x85\xa0  　éßñ中文字ひ한😀՗՘́क्ष٣५ⅷ²¼ĲŉǅЖя")
    for k in range(3000):
        s = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60)))
        if k % 5 == 0:
            s = s[:10] + "<|endoftext|>" + s[10:] + "<|endoftext|><|endoftext|>"
        assert count(s) == len(tok.encode(s, add_special_tokens=False).ids), s
    for s in ("ab" * 20_000, "é" * 5_000, "a b " * 400_000, " " * 3_000):
        assert count(s) == len(tok.encode(s, add_special_tokens=False).ids)


def test_split_agrees_with_the_library_below_the_bound():
    pre, cut = library().pre_tokenizer, TC.load(TC.public_path())[0]
    for c in range(TC.SETTLED + 64):
        s = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}{chr(c)}  b"
        assert list(cut(s)) == [s[a:b] for _, (a, b) in pre.pre_tokenize_str(s)], hex(c)


def test_token_counts_query(spark, tmp_path):
    docs = odd_docs(spark, [None, "", "hello world", "x<|endoftext|>y", "word " * 1025, "中文 é"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_token_counts"](spark, str(tmp_path)).collect()
    tok = library()
    want = [(d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and any(r[3] for r in want)
    assert QUERIES["op13_token_counts"](spark, SF001).count() == spark.read.parquet(f"{SF001}/documents.parquet").count()
