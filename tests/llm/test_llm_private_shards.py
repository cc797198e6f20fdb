"""PII, sharding and WARC: against plain versions, and the defined cases."""

import collections
import hashlib
import math
import re
import uuid
import zlib

from pyspark.sql import functions as F

from conftest import SF001
from sitelens.llm import pii, sharding, warc
from sitelens.session import ensure_checkpoint_dir

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def plain(text):
    found = sorted((m.start(), n, m.end(), k) for n, (k, rx) in enumerate(RX.items()) for m in re.finditer(rx, text or "") if good(k, m.group()))
    return [sum(f[3] == k for f in found) for k in RX], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()


ODD = ["", None, "a@b.c_d@e.f x.y@z..q u@v.w.", "1.2.3.4.5.6.7.8 001.02.0255.0256 1.2.3.4.256.1.1.1", "4111 1111-1111 1111 4111  1111 1111 1111 " + "4111111111111111 " * 3,
       "+1 (499) 555-6503 +49 30 1234567. +1", "9" * 20_000, "a" * 20_000 + "@" + "b." * 5_000 + "c", "1 " * 5_000, "1." * 500 + "1", "\x01a@b.c\x01d 4111\x011111",
       "é+1 234 567 890é a%b@c-d.e-f--.g @x.y a@-.- +12345678901234567", "x@" * 2_000, "+1" + "-" * 5_000]


def test_base_spans(spark):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id bigint, text string, base string, rid string")
    got = {r["doc_id"]: r for r in pii.digests(pii.find(docs, carry=["doc_id"])).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert ([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]], r["base_sha256"]) == plain(t), t and t[:60]


def test_revealing_terms_go(spark):
    rows = [(i, f"Customer Zebulon Quark wrote from mail zq@acme.example.com about thing {i} and the rest of it is ordinary.") for i in range(6)]
    rows += [(10 + i, f"the rest of it is ordinary and the customer wrote about {i}") for i in range(50)] + [(None, None), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = pii.sanitise(docs).collect()
    assert len(out) == len(rows)
    text = {r["doc_id"]: r["text"] for r in out}
    assert "Zebulon" not in text[0] and "Quark" not in text[0] and "<EMAIL>" in text[0] and "the rest of it is ordinary" in text[0]
    assert text[12] == dict(rows)[12] and text[7] == "" and text[None] is None
    copies = spark.createDataFrame([(i, "only Zebulon a@b.cc") for i in range(9)], "doc_id bigint, text string")  # copies of one text are no further evidence
    assert {r["text"] for r in pii.sanitise(copies).collect()} == {"only Zebulon <EMAIL>"}
    assert pii.sanitise(docs.limit(0)).count() == 0


def plain_terms(texts):
    """The term spans of every text by the formula, pair by pair."""
    found = []
    for t in texts:
        base = sorted((m.start(), n, m.end(), m.group()) for n, (k, rx) in enumerate(RX.items()) for m in re.finditer(rx, t or "") if good(k, m.group()))
        masked = list(t or "")
        for a, _, b, _ in base:
            masked[a:b] = "\x01" * (b - a)
        found.append(({(n, m.lower() if n == 0 else re.sub("[^0-9]", "", m)) for _, n, _, m in base}, [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", "".join(masked))]))
    with_term, with_entity, both = (collections.defaultdict(set) for _ in range(3))
    for i, (entities, terms) in enumerate(found):
        for w in set(x.lower() for x in re.findall(r"[^\W_]+", texts[i] or "")):
            with_term[w].add(i)
        for e in entities:
            with_entity[e].add(i)
            for w in {w for _, _, w in terms}:
                both[e, w].add(i)
    n, out = len(texts), []
    for entities, terms in found:
        spans = []
        for a, b, w in terms:
            for e in entities:
                k, share, apart = len({texts[i] for i in both[e, w]}), len(both[e, w]) / max(1, len(with_term[w])), len(with_entity[e]) / n
                chance = (k * share + pii.PRIOR * apart) / (k + pii.PRIOR)
                if with_term[w] and len(with_term[w]) <= pii.COMMON * n and apart < 1 and 1 - math.log2(chance) / math.log2(apart) >= pii.DISCLOSURE:
                    spans.append((a, b))
                    break
        out.append(spans)
    return out


def test_terms_equal_the_formula(spark):
    texts = [r[0] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("text").collect()]
    texts += [f"Contact Zorblax Quimby at q@zed.org today {w}. Later on Zorblax came again." for w in ("about it", "or at noon", "with the rest", "for this")]
    texts += [f"Contact us at noon today, {w} of it is about the rest, and later on they came again for this or with it" for w in map(str, range(30))]
    texts += ["copied Vorple v@copy.org +49 30 1234567"] * 9 + ["many " + " ".join(f"m{k}@list.org" for k in range(300)) + " solitary", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find(docs, carry=["doc_id"])).collect()}
    want = plain_terms(texts)
    mine = [[tuple(map(int, x.split(":")[1:])) for x in got[i].split(",") if x.startswith("term:")] for i in range(len(texts))]
    assert mine == want and sum(map(len, want)) > 20
    first = next(i for i, t in enumerate(texts) if t and t.startswith("Contact Zorblax"))
    text = pii.sanitise(docs).where(F.col("doc_id") == first).first()["text"]
    assert "Zorblax" not in text and "Quimby" not in text and all(w in text for w in ("Contact", "at <EMAIL> today about it. Later on", "came again"))


def test_long_texts_of_many_matches(spark):
    texts = ["1.2.3.4 " * 8_000, " ".join(f"w{k}" for k in range(20_000)) + " a@b.cc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.digests(pii.find(docs, carry=["doc_id"])).collect()}
    assert got[0]["n_ip"] == 8_000 and all(got[k]["base_sha256"] == plain(t)[1] for k, t in enumerate(texts))


def test_sharding(spark):
    rows = [(i, "hot" if i < 400 else f"pair{i // 2}" if i < 800 else f"t{i}" if i < 1198 else None, 1) for i in range(1200)] + [(None, "", 2), (5, "", 3), (5, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    got = sharding.shard_documents(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    where = {r["doc_id"]: r["shard"] for r in got if r["doc_id"] is not None}
    together = sum(where[i] == where[i + 1] for i in range(400, 800, 2))
    assert together >= 190  # linked documents meet, but for those that capacity keeps apart
    assert sharding.shard_documents(docs.limit(0)).count() == 0 and sharding.shard_documents(docs.limit(3)).count() == 3


def test_warc_round_trip(spark):
    x = "x" * 1000
    rows = [(1, "http://a b\n", x), (2, None, x), (7, "u", x), (None, "u", x), (3, "u", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.0 é\r\n" * 3), (8, "u", "y" * 999), (9, "u", "y" * 999), (10, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, digest string")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_pages(pages, f"{ensure_checkpoint_dir(spark)}/w-{uuid.uuid4().hex}").collect()}
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == x and i != 7
        assert got[i] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 7 if again else None)
    assert warc.archive_pages(pages.limit(0), f"{ensure_checkpoint_dir(spark)}/w-{uuid.uuid4().hex}").count() == 0


def test_inflate_follows_members():
    import gzip

    data = [b"abc" * 10, b"", b"d" * 3_000_000]
    assert b"".join(warc.inflate(b"".join(map(gzip.compress, data)))) == b"".join(data)
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r for _, r in warc.split_records(iter([record * 2][0][i:i + 1] for i in range(2 * len(record))))] == [record, record]


def test_query_counts(spark):
    n = spark.read.parquet(f"{SF001}/pages.parquet").count()
    assert warc.warc_query(spark, SF001).where(F.col("payload_digest").isNotNull()).count() == n
