"""The whole job: cases that a cut in the operators would lose."""

import numpy as np
from pyspark.sql import functions as F

from sitelens.llm import html_main, links, nearest, passages

rng = np.random.default_rng(11)


def some(n):
    return " ".join(f"q{x}" for x in rng.integers(0, 10**6, n))


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = passages.repeated_passages(docs).cache()
    return found.collect(), [(r["doc_id"], r["text"]) for r in passages.remove_passages(docs, found).collect()]


def test_a_line_here_and_part_of_a_line_there(spark):
    p, near = some(60), some(120)
    other = near.split()
    other[3] = "changed"
    rows = [(1, some(30) + " " + p + " " + some(30)), (5, some(40) + "\n" + p), (9, p + "\n" + some(40)),
            # one-line documents that are near copies, and an unrelated one with a passage of theirs
            (20, near), (21, " ".join(other)), (30, some(30) + " " + " ".join(near.split()[40:100]) + " " + some(30))]
    out, clean = removed(spark, rows)
    text = dict(rows)
    holders = {r["doc_id"] for r in out if r["kind"] == "passage" and text[r["doc_id"]][r["s"]:r["e"]] in p}
    assert holders == {1, 5, 9}
    assert [i for i, t in clean if p in t] == [1]
    assert {r["doc_id"] for r in out if r["kind"] == "passage" and text[r["doc_id"]][r["s"]:r["e"]] in near} >= {20, 21, 30}
    assert not any(r["kept"] for r in out if r["doc_id"] == 30)


def test_pair_whose_first_band_agrees_in_its_bytes_only(spark):
    """Items 1 and 2 share the key of band 1 and, by their bytes alone, band 0; the leaders of that key are others."""
    n = 40
    sets = [(i, list(range(100 * i, 100 * i + 20))) for i in range(n)]
    sets[2] = (2, [*range(100, 119), 200])
    keys = [(i, [64 * (i + 1), 64 * 7 + 1]) for i in range(n)]
    sketch = [(i, bytearray([1, 2, 3, 4] if i in (1, 2) else [i + 10, 2, 3, 4])) for i in range(n)]
    apart = spark.createDataFrame(keys, "id long, keys array<long>")
    found = links.similar_components(apart.select("id", F.explode("keys").alias("key")), apart.join(spark.createDataFrame(sketch, "id long, sketch binary"), "id"),
                                     spark.createDataFrame(sets, "id long, items array<long>"), 0.8)
    assert {r["id"]: r["comp"] for r in found.collect()} == {1: 1, 2: 1}


def test_search_does_not_pass_over_low_estimates(spark):
    n = 40
    sets = [(i, list(range(100 * i, 100 * i + 20))) for i in range(n)]
    sets[2] = (2, [*range(100, 119), 200])
    apart = spark.createDataFrame([(i, [64 * (i + 1), 64 * 7 + 1], bytearray([i, i, 3, 4])) for i in range(n)], "id long, keys array<long>, sketch binary")
    found = links.similar_components(apart.select("id", F.explode("keys").alias("key")), apart, spark.createDataFrame(sets, "id long, items array<long>"), 0.8)
    assert {r["id"]: r["comp"] for r in found.collect()} == {1: 1, 2: 1}


def test_query_rows_of_one_id_have_ten_neighbours_each(spark):
    x = rng.standard_normal((60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (0, x[1].tolist())]
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = nearest.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") == 0).collect()
    want = []
    for q in np.flatnonzero(ids == 0):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        want += [(rank + 1, int(ids[i]), round(float(d[i]), 9)) for rank, i in enumerate([i for i in np.lexsort((ids, d)) if i != q][:10])]
    assert sorted((r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)


def test_spans_are_cut_out_of_their_own_text_only(spark):
    p, q = some(60), some(60)
    clean_text = some(200)
    rows = [(1, p), (2, some(30) + "\n" + p), (2, clean_text), (None, q), (None, some(50) + "\n" + q), (None, clean_text[:-1] + "z")]
    _, clean = removed(spark, rows[:3] + rows[3:5])
    assert (2, clean_text) in clean and sum(p in t for _, t in clean) == sum(q in t for _, t in clean) == 1
    assert len(clean) == 5 and (1, p) in clean


def test_passages_go_to_their_last_word_and_repeats_inside_one_document(spark):
    shared = [some(n) for n in range(passages.REACH + passages.WINDOW + 1, 90, 4)]
    rows = [(100 * k + i, " ".join([some(7 * i + 40 - k), p, some(30 + 5 * i)])) for k, p in enumerate(shared) for i in range(3)]
    line, inline = some(30), some(60)
    rows += [(9000, "\n".join([line, some(28), line, some(33), line])), (9001, " ".join([some(35), inline, some(50), inline, some(20)]))]
    # 9003 and 9004 share more than either does with 9002
    core, left, right = some(50), some(12), some(12)
    rows += [(9002, " ".join([some(40), core, some(40)]))] + [(k, " ".join([some(40), left, core, right, some(40)])) for k in (9003, 9004)]
    # a text that repeats itself, in two documents
    rows += [(k, " ".join([some(40), *["one two three"] * 100, some(40)])) for k in (9005, 9006)]
    out, clean = removed(spark, rows)
    clean = dict(clean)
    for k, p in enumerate(shared):
        assert p in clean[100 * k]
        for i in (1, 2):
            assert not set(p.split()) & set(clean[100 * k + i].split())
            assert len(clean[100 * k + i].split()) == len(rows[3 * k + i][1].split()) - len(p.split())
    assert clean[9000].count(line) == 1 and clean[9000].split()[:30] == line.split() and {r["kind"] for r in out if r["doc_id"] == 9000} >= {"repeat"}
    assert clean[9001].count(inline) == 1 and sum(w in inline.split() for w in clean[9001].split()) == 60
    assert not set((left + " " + core + " " + right).split()) & set(clean[9004].split()) and not set(core.split()) & set(clean[9003].split())
    assert "three" not in clean[9006].split()


def test_article_goes_on_after_a_self_closed_svg_and_keeps_math_and_object():
    def words(page):
        p = html_main.Page(page)
        return " ".join(t for _, t in p.stream if t)

    for tag in ('<svg class="icon"/>', "<svg/>", "<svg />", "<math/>", "<svg class='icon'>", "<svg><path d='M0'/></svg>"):
        got = words(f"<article><p>before {tag}<p>after the icon</p><p>end</p></article>")
        assert "before" in got and "after the icon" in got and "end" in got, tag
    got = words("<article><p>energy <math><mi>mass</mi></math> <object data=x>fallback</object> rest</p><svg><text>drawn</text></svg></article>")
    assert all(w in got for w in ("energy", "mass", "fallback", "rest")) and "drawn" not in got


def test_links_of_small_keys_and_of_large_ones_give_the_same_components(spark, monkeypatch):
    own = np.random.default_rng(23)
    # chains: each set is similar to the next one only, and no set is similar to its key's leader
    sets, keys = [], []
    for c in range(6):
        base = np.sort(own.choice(10**6, 200, replace=False))
        for k in range(4):
            sets.append((4 * c + k, base[12 * k:12 * k + 100].tolist()))
            keys.append((4 * c + k, [(c % 3) * 64, ((100 + c) << 8) + 1]))
    items = spark.createDataFrame(sets, "id long, items array<long>")
    sketches = spark.createDataFrame([(i, k, bytes(4)) for i, k in keys], "id long, keys array<long>, sketch binary")
    long = sketches.select("id", F.explode("keys").alias("key"))
    grouped = {}
    verified = links.verified
    joined = []
    for few in (0, 16):
        monkeypatch.setattr(links, "FEW", few)
        monkeypatch.setattr(links, "verified", lambda pairs, *a: joined.append((links.FEW, pairs.count())) or verified(pairs, *a))
        grouped[few] = {r["id"]: r["comp"] for r in links.similar_components(long, sketches, items, 0.75).collect()}
    want = {4 * c + k: 4 * c for c in range(6) for k in range(4)}
    assert grouped[0] == grouped[16] == want
    assert [n for few, n in joined if few == 0][-1] == 0 < [n for few, n in joined if few == 16][-1]  # pairs of small keys met in a join
