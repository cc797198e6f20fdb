"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal them.

Base spans (e-mail, IP address, card, phone) protect *entities*: the values
found.  A term co-occurs with an entity in every text that holds both, however
far apart.  Over the whole corpus, let N be all texts, n(t) and n(e) those that
hold a term or an entity, c(t, e) those that hold both.  The term reveals

    PMI(t; e) / IC(e) = log2(p N / n(e)) / log2(N / n(e)) = 1 + log2(p) / IC(e)

of the entity's information, p being the chance that a text with the term
holds the entity.  p is estimated from k different texts (copies of one text
are no further evidence) and drawn towards the chance without the term:

    p = (k c / n(t) + PRIOR n(e) / N) / (k + PRIOR)

so an entity of a single text is judged too, more carefully than one of many.
From ``DISCLOSURE`` on, every occurrence of the term in every text that holds
the entity is a span: generalised to a placeholder, or removed from
``REMOVAL`` on.  Terms that more than ``COMMON`` of all texts hold tell nobody
apart and stay.  Texts without an entity are left alone.

A term can only reach the threshold beside an entity if n(t) is at most
n(e) / 2^((DISCLOSURE - 1) IC(e)); the pairs of a text are cut to those before
they are formed, and entities of exactly the same texts are one, so a text with
thousands of addresses of its own pairs its terms once.

All of it is DataFrame expressions.  The patterns are written so that Java's
matcher neither recurses nor tries a run again from each of its characters, so
very long runs cost linear time: separators that may stand inside a match are
first marked with one control character, which turns nested repetitions into
plain runs of a class.  Places are running sums taken in chunks, so a text of
many matches does not copy a growing array once per match.

Defined cases: a null text is an empty one (no spans, the digest of the empty
string); rows are handled one by one, so repeated and null ids are fine; spans
of several kinds may overlap in the result, and in a sanitised text the one
that begins first (the longest, then the first kind) wins; where all texts hold
an entity it has no information and no term reveals it; an empty table
gives no rows; extra columns are carried by ``sanitise`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import common as C

KINDS = ["email", "ip", "card", "phone", "term"]
DISCLOSURE = 0.9
REMOVAL = 0.98
#: Weight, in texts, of the chance without the term.
PRIOR = 0.5
#: Terms of more than this share of all texts stay.
COMMON = 1 / 8
CHUNK = 512
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}

TERM = r"[\p{L}\p{N}]+"
# A start inside a run fails whenever the run's first character fails, so only that one is tried - or the
# place where the last match ended (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9\x01]{2,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
INNER_DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
INNER_SEPARATOR = r"(?<=[0-9])[\x20-](?=[0-9])"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(pairs: Column) -> Column:
    """``array<struct<s, e, m>>`` from ``array<struct<gap, m>>``: running sums within chunks, shifted by the chunks before."""
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

    def chunk(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    def joined(state: Column, x: Column) -> Column:
        moved = F.struct(state["at"].alias("off"), x["out"].alias("out"))
        return F.struct((state["at"] + x["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    none = F.array().cast("array<struct<off:int,out:array<struct<s:int,e:int,m:string>>>>")

    def cut(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(CHUNK))
        chunks = F.transform(starts, lambda i: chunk(F.slice(x, i, F.lit(CHUNK))))
        offsets = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("out")), joined, lambda s: s["out"])
        shift = lambda c: F.transform(c["out"], lambda y: F.struct((y["s"] + c["off"]).alias("s"), (y["e"] + c["off"]).alias("e"), y["m"].alias("m")))
        return F.flatten(F.transform(offsets, shift))

    return _bound(pairs, cut)


def _found(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<s, e, m>>`` (code points, end exclusive): the pieces between give the places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    zipped = lambda m: F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: F.struct(F.length(g).alias("gap"), x.alias("m")))
    return _bound(matches, lambda m: F.when(F.size(m) > 0, _placed(zipped(m))).otherwise(empty))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i))
    return total % 10 == 0


def _small(part: Column) -> Column:
    """Whether a run of digits is at most 255."""
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def _kind(kind: str, text: Column) -> Column:
    """The accepted spans of one kind; those that fail are dropped without another try."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    marked = F.translate(text, "\x01", "\x02")
    if kind == "email":
        return F.when(F.contains(text, F.lit("@")), _found(F.regexp_replace(marked, INNER_DOT, "\x01"), EMAIL)).otherwise(none)
    if kind == "phone":
        many = lambda x: F.length(_digits(x["m"])).between(9, 15)
        return F.when(F.contains(text, F.lit("+")), F.filter(_found(text, PHONE), many)).otherwise(none)
    if kind == "ip":
        fit = lambda x: F.forall(F.split(x["m"], r"\."), _small)
        return F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_found(text, IP), fit)).otherwise(none)
    long = lambda x: F.when(F.length(_digits(x["m"])).between(12, 19), _luhn(_digits(x["m"]))).otherwise(F.lit(False))
    return F.when(text.rlike("[0-9]"), F.filter(_found(F.regexp_replace(marked, INNER_SEPARATOR, "\x01"), CARD), long)).otherwise(none)


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base``: ``array<struct<s, k, e, m>>`` by start, then kind (``k`` counts ``KINDS``)."""
    clean = C.text_or_empty(text)
    found = docs.withColumns({f"_{kind}": _kind(kind, clean) for kind in KINDS[:4]})

    def numbered(n: int) -> Column:
        return F.transform(f"_{KINDS[n]}", lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e"), x["m"].alias("m")))

    parts = [numbered(n) for n in range(4)]
    return found.withColumn("base", F.array_sort(F.concat(*parts))).drop(*[f"_{kind}" for kind in KINDS[:4]])


def _masked(text: Column) -> Column:
    """The text with every character of a base span replaced, so that no term reaches into one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = F.greatest(x["s"], state["at"])
        piece = F.substring(text, state["at"] + 1, begin - state["at"])
        return F.struct(F.greatest(x["e"], state["at"]).alias("at"), F.concat(state["out"], F.array(piece, F.repeat(F.lit("\x01"), x["e"] - begin))).alias("out"))

    return F.aggregate("base", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["k"], F.when(span["k"] == 0, F.lower(span["m"])).otherwise(_digits(span["m"])))


def _terms(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _highest(ne: Column, total: int) -> Column:
    """The most texts that may hold a term which reaches ``DISCLOSURE`` beside an entity of ``ne`` texts."""
    return ne * F.pow(F.lit(float(total)) / ne, F.lit(1 - DISCLOSURE))


def entity_groups(rows: DataFrame) -> DataFrame:
    """``(rid, th, group, ne)``: the entities of every row, those of exactly the same rows as one group."""
    held = rows.where(F.size("base") > 0).select("rid", "th", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    # the rows of an entity, as two order-free digests: partial sums, so an entity of a third of all rows is one row per task
    same = held.groupBy("entity").agg(F.count("*").alias("ne"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), F.col("rid"))).alias("y"))
    return held.join(same, "entity").select("rid", "th", F.xxhash64("x", "y", "ne").alias("group"), "ne").distinct()


def revealing_terms(rows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``(rid, term, ratio)``: the terms that reveal an entity of their row, from ``rows(rid, th, base, masked)`` and the corpus."""
    # every text counts once for each of its terms; a task sends one row per term
    counts = C.write_once(docs.select(F.explode(_terms(C.text_or_empty(text))).alias("term")).groupBy("term").agg(F.count("*").alias("nt")), "pii-terms")
    total = rows.count()
    groups = C.write_once(entity_groups(rows).withColumn("highest", _highest(F.col("ne"), total)), "pii-entities")
    held = rows.where(F.size("base") > 0).select("rid", F.explode(_terms(F.col("masked"))).alias("term"))
    most = groups.agg(F.max("highest")).first()[0] or 0.0
    # terms held too often for any entity are not looked at; a term cut by a mask may not be among the counts
    rare = counts.where((F.col("nt") <= COMMON * total) & (F.col("nt") <= most))
    beside = held.join(rare, "term").join(groups, "rid").where("nt <= highest")
    beside = C.write_once(beside.select("rid", "th", "term", "nt", "group", "ne"), "pii-beside")
    texts = beside.groupBy("group", "term", "ne", "nt", "th").agg(F.count("*").alias("c"))
    pairs = texts.groupBy("group", "term", "ne", "nt").agg(F.sum("c").alias("c"), F.count("*").alias("k"))
    apart = F.col("ne") / F.lit(float(max(total, 1)))
    chance = (F.col("k") * (F.col("c") / F.col("nt")) + PRIOR * apart) / (F.col("k") + PRIOR)
    information = -F.log2(apart)
    ratio = F.when(information > 0, 1 + F.log2(chance) / information).otherwise(F.lit(0.0))
    rated = pairs.select("group", "term", ratio.alias("ratio")).where(F.col("ratio") >= DISCLOSURE)
    return beside.join(rated, ["group", "term"]).groupBy("rid", "term").agg(F.max("ratio").alias("ratio"))


def find(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the ``carry`` columns, all by default), ``base`` and ``terms`` (``array<struct<s, k, e, ratio>>``) per row."""
    carry = docs.columns if carry is None else carry
    source = docs.select(F.struct(*carry).alias("row"), F.col(text).alias("_text"))
    found = with_base_spans(source, "_text").withColumn("th", F.xxhash64("_text"))
    masked = found.withColumn("masked", F.when(F.size("base") > 0, _masked(C.text_or_empty("_text")))).drop("_text")
    rows = C.with_row_id(masked, "pii-base")
    revealing = C.settled(lambda: revealing_terms(rows.select("rid", "th", "base", "masked"), docs, text), "pii-revealing", docs.sparkSession)
    places = (rows.where(F.size("base") > 0).select("rid", F.explode(_found(F.col("masked"), TERM)).alias("x"))
              .select("rid", F.lower("x.m").alias("term"), "x.s", "x.e"))
    # a row's list is bounded by its own text
    hits = (places.join(revealing, ["rid", "term"]).groupBy("rid")
            .agg(F.array_sort(F.collect_list(F.struct("s", F.lit(4).alias("k"), "e", "ratio"))).alias("terms")))
    joined = rows.join(hits, "rid", "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int,ratio:double>>")
    return joined.select("row", "base", F.coalesce("terms", none).alias("terms"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def _bare(spans: Column | str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, counts per kind, the digest of the base spans and all spans as text."""
    def counted(n: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == n)).cast("long").alias(f"n_{KINDS[n]}")

    counts = [counted(n) for n in range(4)]
    every = F.array_sort(F.concat(_bare("base"), _bare("terms")))
    return found.select(F.col(f"row.{key}").alias(key), *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"),
                        F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by placeholders and terms that reveal most removed."""
    found = find(docs, text)
    whole = F.col("row")[text]
    marks = F.array(*[F.lit(PLACEHOLDERS[k]) for k in KINDS])
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("less"), x["k"].alias("k"), F.element_at(marks, x["k"] + 1).alias("put")))
    terms = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("less"), x["k"].alias("k"),
                                                    F.when(x["ratio"] >= REMOVAL, F.lit("")).otherwise(F.lit(PLACEHOLDERS["term"])).alias("put")))
    spans = F.array_sort(F.concat(base, terms))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        piece = F.substring(whole, state["at"] + 1, x["s"] - state["at"])
        return F.when(x["s"] < state["at"], state).otherwise(
            F.struct((-x["less"]).alias("at"), F.concat(state["out"], F.array(piece, x["put"])).alias("out")))

    walked = F.aggregate(spans, start, step)
    rest = F.substring(whole, walked["at"] + 1, F.length(whole))
    clean = F.when(F.size("base") + F.size("terms") > 0, F.concat(F.array_join(walked["out"], ""), rest)).otherwise(whole)
    columns = [clean if c == text else F.col("row")[c] for c in docs.columns]
    return found.select(*[v.alias(c) for v, c in zip(columns, docs.columns)])


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document."""
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(find(docs, carry=["doc_id"]))
