"""Near duplicates, passages, nearest neighbours, HTML and the pipeline: against brute force, and the defined cases."""

import collections
import html
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from conftest import SF001, SF01
from pyspark.sql import functions as F
from sitelens.llm import common as C
from sitelens.llm import dart_minhash as D
from sitelens.llm import html_main as H
from sitelens.llm import mixing, near_dedup, nearest, passages, pii, quality_rules


def shingles(words, k=5):
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def classes(sets, threshold=0.8):
    """Components of all pairs at the threshold (an inverted index finds the pairs)."""
    up = list(range(len(sets)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    seen = set()
    for members in index.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                        up[top(a)] = top(b)
    out = collections.defaultdict(list)
    for i in range(len(sets)):
        out[top(i)].append(i)
    return list(out.values())


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a = rng.uniform(0.1, 9, 60)
    b = a * rng.uniform(0.4, 1.6, 60)
    ranks = D.signatures(np.repeat([0, 1], 60), np.concatenate([h, h]), np.concatenate([a, b]), 2, 8192)
    assert abs((ranks[0] == ranks[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02
    empty = D.signatures(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), 2, 8)
    assert (empty == D.EMPTY).all()


def test_near_duplicates_equal_brute_force(spark):
    words = [f"w{k}" for k in range(400)]
    rng = np.random.default_rng(2)
    base = [str(x) for x in rng.choice(words, 150)]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    for k in range(120):  # a large group of near copies that are hardly similar among themselves
        copy = list(base)
        for at in rng.choice(150, 1 + k % 5, replace=False):
            copy[at] = f"x{k}_{at}"
        rows.append((10_000 + k, " ".join(copy)))
    rows += [(20_000 + k, "same text here " * 20) for k in range(50)] + [(20_000, "same text here " * 20), (None, "same text here " * 20), (30_000, ""), (30_001, None), (30_002, " \n"), (30_003, "a b"), (30_004, "a  b"), (30_005, "z" * 100_000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, class_id int")
    got = near_dedup.near_duplicate_classes(docs).select("doc_id", "class_id", "class_size", "kept").collect()
    assert len(got) == len(rows)
    sets = [shingles((t or "").split()) for _, t in rows]
    want = {}
    for members in classes([s or {("own", k)} for k, s in enumerate(sets)]):
        first = min(rows[m][0] for m in members if rows[m][0] is not None)
        want |= {rows[m][0]: (first, len(members)) for m in members}
    assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in got} == want
    kept = collections.Counter(r["class_id"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({c for c, _ in want.values()})
    assert near_dedup.near_duplicate_classes(docs.limit(0)).count() == 0


def test_passages_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    rng = np.random.default_rng(3)
    some = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    inline = some(51)
    rows += [(50_000 + k, some(40 * k) + " " + inline + " " + some(30)) for k in range(1, 4)] + [(50_010, inline.replace(" ", "\n", 30) + "\n" + some(9)), (50_020, some(300)), (None, some(60)), (50_030, None), (50_031, "")]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id bigint, text string, kind string")
    out = passages.repeated_passages(docs).collect()
    text = dict(rows)
    lines = [(i, line.split()) for i, t in rows for line in (t or "").split("\n") if len(line.split()) >= passages.LEAST_WORDS]
    want = set()
    for members in classes([shingles(w) for _, w in lines]):
        if len({lines[m][0] for m in members}) > 1:
            want |= {(lines[m][0], " ".join(lines[m][1])) for m in members}
    assert {(r["doc_id"], " ".join(text[r["doc_id"]][r["s"]:r["e"]].split())) for r in out if r["kind"] == "paragraph"} == want
    found = {r["doc_id"] for r in out}
    assert {50_001, 50_002, 50_003, 50_010} <= found and not {50_020, None, 50_030, 50_031} & found
    for c in {r["class_id"] for r in out}:
        assert sum(r["kept"] for r in out if r["class_id"] == c) <= 1
    df = spark.createDataFrame([r[0:2] + (r[2], r[3], r[4], r[5], r[6]) for r in map(tuple, out)], "doc_id bigint, kind string, s int, e int, class_id bigint, class_docs bigint, kept boolean")
    clean = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs, df).collect()}
    assert clean[50_020] == text[50_020] and clean[50_030] is None and len(clean) == len(rows)
    assert sum(inline in (t or "") for t in clean.values()) <= 1
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_every_long_enough_passage_has_a_window():
    rng = np.random.default_rng(4)
    some = lambda n: [f"u{x}" for x in rng.integers(0, 10**6, n)]
    for _ in range(50):
        shared = some(passages.REACH + passages.WINDOW + 1)
        sets = []
        for _ in range(2):
            words = some(int(rng.integers(0, 80))) + shared + some(int(rng.integers(0, 80)))
            lines = passages.Lines(pa.array([" ".join(words)], pa.large_string()))
            sets.append({tuple(words[k:k + passages.WINDOW]) for k in passages._anchors(lines)})
        assert sets[0] & sets[1]


def nearest_plain(ids, x, query, k):
    d = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
    d[ids == ids[query]] = np.inf
    return [(int(ids[i]), d[i]) for i in np.lexsort((ids, d))[:k] if np.isfinite(d[i])]


def test_nearest_recall_and_scores(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    got = nearest.nearest_query(spark, SF01).toPandas()
    hits = total = 0
    for q, rows in got.groupby("query_id"):
        want = nearest_plain(ids, x, int(np.flatnonzero(ids == q)[0]), 10)
        rows = rows.sort_values("rank")
        assert list(rows["rank"]) == list(range(1, 11)) and list(zip(rows.score, rows.vec_id)) == sorted(zip(rows.score, rows.vec_id))
        exact = dict(nearest_plain(ids, x, int(np.flatnonzero(ids == q)[0]), len(ids)))
        assert all(abs(exact[v] - s) < 1e-12 for v, s in zip(rows.vec_id, rows.score))
        hits += len({v for v, _ in want} & set(rows.vec_id))
        total += 10
    assert got["query_id"].nunique() == (ids % 100 == 0).sum() and hits / total >= 0.9


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (100, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (200, [0.5, 0.5]), (0, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, rank int")
    got = nearest.search(df, F.col("id") % 100 == 0)
    assert {r["query_id"] for r in got.collect()} == {0, 200}
    assert [r["vec_id"] for r in got.where("query_id = 200").orderBy("rank").collect()][:2] == [1, 3]  # ties to the smaller id
    assert nearest.search(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_html_main_text(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet").toPandas()["html"].tolist()
    model = H.learn(pages[:100])

    def plain(s):
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", s, re.S)[1])
        return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())

    assert H.extract(pages, model) == [plain(s) for s in pages]
    varied = [H.Page(s) for s in H.training_pages(pages[100:], seed=5)[1::2]]
    x, chars, begin = H.describe(varied)
    score = np.clip(model.score(x), -6, 6)
    right = wrong = 0.0
    for p, a, b in zip(varied, begin[:-1], begin[1:]):
        main, truth = H.decode(p, score[a:b], chars[a:b]), H._labels(p)
        right += chars[a:b][main == truth].sum()
        wrong += chars[a:b][main != truth].sum()
        for i in range(1, len(p.tag)):  # nothing is main below a cut
            up = p.parent[i]
            assert not main[i] or main[up] or not any(main[k] for k in _above(p, up))
    assert wrong / (right + wrong) < 0.02


def _above(page, i):
    while i > 0:
        i = page.parent[i]
        yield i


def test_html_odd_rows(spark):
    body = "<p>a<b>b</b> c&amp;d&nbsp;e<br>f<p>" + "Long enough, it seems, to be an article. " * 8
    rows = [(1, "u", f"<nav><a href=x>menu</a></nav><article>{body}<script>var a='</p>';</script></article><footer>no</footer>"), (2, None, None), (3, "u", ""), (None, "u", "<" * 500), (4, "u", "<div><p>" * 300), (4, "u", "<div><p>" * 300)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    got = H.main_texts(df, H.fit(df)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    first = next(r["text"] for r in got if r["page_id"] == 1)
    assert first.startswith("ab c&d e f Long enough") and "menu" not in first and "no" != first[-2:] and "var" not in first
    assert H.main_texts(df.limit(0), H.fit(df.limit(0))).count() == 0


def test_pipeline(spark):
    docs = C.read_table(spark, SF001, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = C.write_once(stage(spark, docs, SF001), f"test-{name}")
        assert out.columns == columns
        if name == "near_dedup":
            sets = [shingles(r["text"].split()) for r in out.collect()]
            assert all(len(c) == 1 for c in classes(sets))
        if name != "mixing":
            assert 0 < out.count() <= docs.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert last.count() == docs.count()
    assert corpus_pipeline.run(spark, SF001).count() == docs.count()


def test_pipeline_on_odd_and_empty_tables(spark):
    docs = C.read_table(spark, SF001, "documents")
    odd = docs.limit(30).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0)], docs.schema))
    for table in (odd, docs.limit(0)):
        current = table
        for name, stage in corpus_pipeline.STAGES:
            current = C.write_once(stage(spark, current, SF001), f"test-odd-{name}")
        assert current.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_with_clashing_columns(spark):
    docs = C.read_table(spark, SF001, "documents").limit(80)
    own = {n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in ("kept", "stats", "copies", "_copy", "base_failed", "rid", "key", "size", "comp", "base", "row")}
    table = docs.withColumns(own)
    known = {r["doc_id"]: tuple(r[n] for n in own) for r in table.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = C.write_once(stage(spark, table, SF001), f"test-clash-{name}")
        assert table.columns == [*docs.columns, *own]
        assert all(tuple(r[n] for n in own) == known[r["doc_id"]] for r in table.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, table, SF001).count() == table.count() > 20


def test_pipeline_stages_against_plain_versions(spark):
    docs = C.read_table(spark, SF001, "documents")
    rows = docs.collect()
    kept = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, SF001).collect()}
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.quality_query(spark, SF001).collect()}
    assert kept == {d for d, k in verdicts.items() if k}
    one = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF001).collect()}
    groups = classes([shingles((r["text"] or "").split()) for r in rows])
    assert len(one) == len(groups) and all(sum(rows[k]["doc_id"] in one for k in g) == 1 for g in groups)
    hidden = {r["doc_id"]: r["text"] for r in corpus_pipeline.hide_personal_data(spark, docs, SF001).collect()}
    clean = {r["doc_id"] for r in pii.pii_query(spark, SF001).where("spans = ''").collect()}
    assert clean and all(hidden[r["doc_id"]] == r["text"] for r in rows if r["doc_id"] in clean)
    assert all("@" not in (hidden[r["doc_id"]] or "") or "@" in (r["text"] or "") for r in rows)
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    target = {r["source"]: r["target"] for r in mixing.mixing_query(spark, SF001).join(docs.select("doc_id", "source"), "doc_id").collect()}
    got, most = collections.Counter(), collections.Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, SF001).groupBy("doc_id").count().collect():
        assert r["count"] <= 2
        got[source[r["doc_id"]]] += r["count"] * words[r["doc_id"]]
    for d in words:
        most[source[d]] = max(most[source[d]], words[d])
    assert all(abs(got[x] - target[x]) <= 2 * most[x] for x in target)
