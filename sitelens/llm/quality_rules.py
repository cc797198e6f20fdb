"""Quality rules: a learned decision list over statistics of whole texts.

Every text is reduced to a row of statistics (vectorised, inside Spark tasks).
Sequential covering then learns an ordered list of rules for the rejected
class: a rule is a conjunction of thresholds, grown condition by condition for
the largest gain in information on one part of the labelled rows, and pruned
condition by condition on the other part.  The list is emitted as one Spark
``CASE WHEN`` over the statistics, so the verdict on all rows is a column
expression, not Python.

Defined cases: a null text has the statistics of an empty one; a text without
words fails the base rules; with no labelled rows, or only one class, the list
is empty and only the base rules reject; repeated ``doc_id`` rows are judged
one by one; labels without a document are ignored, and of several labels of
one document the lowest counts; extra columns are kept where the function
says so and never clash (statistics live in one struct column).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import common as C
from sitelens.llm import text_arrays as A

#: Most labelled rows the list is learned from (the bound of the sample that reaches the driver).
FIT_ROWS = 20_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further counts that only the learned rules read.
EXTRA = ["n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_stops", "n_bars", "n_distinct_words", "n_symbol_words"]
STATS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS + EXTRA)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"):ord("9") + 1] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:"]] = True


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a column; whole texts, whatever their length."""
    parts = [_chunk_statistics(column.slice(a, b - a)) for a, b in A.chunks(column)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in COUNTS + EXTRA}


def _chunk_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    t = A.Texts(column)
    begin, end, owner = t.words()
    out = {"n_words": np.bincount(owner, minlength=t.n)}
    head = (t.bytes & 0xC0) != 0x80
    solid = ~A._SPACE[t.bytes]
    out["word_chars"] = t.count(head & solid)
    out["n_chars"] = t.count(head)
    symbol = _SYMBOL[t.bytes]
    out["n_symbols"] = t.count(symbol)
    for name, table in (("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK), ("n_stops", _STOP)):
        out[name] = t.count(table[t.bytes])
    out["n_bars"] = t.count(t.bytes == ord("|"))
    words = t.hash_spans(begin, end)
    out["n_distinct_words"] = np.bincount(_firsts(words, owner), minlength=t.n)
    sums = np.concatenate(([0], np.cumsum(symbol)))
    out["n_symbol_words"] = np.bincount(owner[sums[end] > sums[begin]], minlength=t.n)
    out["n_repeat_words"] = _repeated_words(words, owner, t.n)
    out["n_lines"], out["n_dup_lines"] = _lines(t, solid)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _firsts(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The owner of each distinct (owner, hash)."""
    return owner[np.unique(hashes ^ A.seeded(owner.astype(np.uint64), 7), return_index=True)[1]]


def _repeated_words(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Words that lie in a window of eight words found at least twice in their text."""
    hashes, first = A.windows(words, owner, REPEAT_WINDOW)
    if not len(hashes):
        return np.zeros(n, np.int64)
    key = hashes ^ A.seeded(owner[first].astype(np.uint64), 7)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + REPEAT_WINDOW, -1)
    return np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=n)


def _lines(t: A.Texts, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and those with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(t.bytes == 0x0A)
    begin = np.concatenate((t.offsets[:-1], breaks + 1))
    owner = np.concatenate((np.arange(t.n), t.text_of(breaks)))
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.concatenate((begin[1:] - 1, [0])) if len(begin) else begin
    last = np.concatenate((owner[1:] != owner[:-1], [True])) if len(owner) else np.zeros(0, bool)
    end = np.where(last, t.offsets[owner + 1], end)
    lines = np.bincount(owner, minlength=t.n)
    sums = np.concatenate(([0], np.cumsum(solid)))
    wordy = sums[end] > sums[begin]
    hashes = t.hash_spans(begin[wordy], end[wordy])
    total = np.bincount(owner[wordy], minlength=t.n)
    return lines, total - np.bincount(_firsts(hashes, owner[wordy]), minlength=t.n)


def with_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with a struct of the counts of each row's text (all other columns stay as they are)."""
    C.ship(docs.sparkSession)

    kind = pa.struct([(c, pa.int64()) for c in COUNTS + EXTRA])

    @F.arrow_udf(f"struct<{', '.join(f'{c}: bigint' for c in COUNTS + EXTRA)}>")
    def count(texts: pa.Array) -> pa.Array:
        made = statistics(texts)
        out = pa.StructArray.from_arrays([pa.array(made[c], pa.int64()) for c in COUNTS + EXTRA], fields=list(kind))
        made = None
        C.give_back()
        return out

    count = count.asNondeterministic()  # a later filter on the counts must not count twice
    return docs.withColumn(out, count(F.col(text)))


def features(stats: str = "stats") -> dict[str, Column]:
    """The measures that rules may test, from the counts; each is a plain ratio with a defined value for no words."""
    c = {k: F.col(f"{stats}.{k}").cast("double") for k in COUNTS + EXTRA}
    words, chars = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["word_chars"], F.lit(1.0))
    lines = F.greatest(c["n_lines"], F.lit(1.0))
    return {
        "word_length": c["word_chars"] / words,
        "symbols_per_word": c["n_symbols"] / words,
        "symbol_words": c["n_symbol_words"] / words,
        "dup_lines": c["n_dup_lines"] / lines,
        "repeat_words": c["n_repeat_words"] / words,
        "upper": c["n_upper"] / chars,
        "digits": c["n_digits"] / chars,
        "marks_per_word": c["n_marks"] / words,
        "stops_per_word": c["n_stops"] / words,
        "bars_per_word": c["n_bars"] / words,
        "words_per_line": c["n_words"] / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def test(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        limit = F.lit(float(self.threshold))
        return of[self.feature] > limit if self.above else of[self.feature] <= limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.test(x)
    return hit


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Condition] | None:
    """The threshold with the largest information gain for the rejected class among the rows still inside."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    if not p0 or not n0:
        return None
    before = np.log2(p0 / (p0 + n0))
    best: tuple[float, Condition] | None = None
    for name in sorted(x):
        v = x[name][inside]
        order = np.argsort(v, kind="stable")
        v, y = v[order], bad[inside][order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p_low = np.cumsum(y)[cut].astype(float)
        n_low = np.cumsum(~y)[cut].astype(float)
        middle = (v[cut] + v[cut + 1]) / 2
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-12):
                best = (float(gain[k]), Condition(name, above, float(middle[k])))
    return best


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (found := _best_condition(x, bad, inside)):
        rule += (found[1],)
        inside &= found[1].test(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop conditions from the end while that does not lower (p - n) / (p + n) on the pruning rows."""
    def worth(r: Rule) -> float:
        hit = _covers(r, x, len(bad))
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best, value = rule, worth(rule)
    for k in range(len(rule) - 1, 0, -1):
        shorter = rule[:k]
        if (w := worth(shorter)) >= value:
            best, value = shorter, w
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 24, max_conditions: int = 6,
          least_precision: float = 0.9, least_cover: int = 3, seed: int = 17) -> list[Rule]:
    """Sequential covering: rules for the rows marked ``bad``, each learned on what the earlier ones leave.

    A rule must be right on ``least_precision`` of the rows it covers and cover
    at least ``least_cover`` bad ones, else covering ends: a clean document is
    dearer than a missed bad one.
    """
    x = {k: np.asarray(v, float) for k, v in x.items()}
    bad = np.asarray(bad, bool)
    left = np.ones(len(bad), bool)
    part = A.seeded(np.arange(len(bad), dtype=np.uint64), seed) % np.uint64(3)
    rules: list[Rule] = []
    misses = 0
    while len(rules) < max_rules and bad[left].sum() >= least_cover:
        turn = (part + np.uint64(len(rules) + misses)) % np.uint64(3)
        grow, prune = left & (turn != 0), left & (turn == 0)
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_conditions)
        if rule and prune.any():
            rule = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        hit = left & _covers(rule, x, len(bad))
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        if not rule or p < least_cover or p < least_precision * (p + n):
            misses += 1
            if misses > 2:  # each third of the rows has been the pruning part once
                break
            continue
        rules.append(rule)
        left &= ~hit
        misses = 0
    return rules


def verdict(rules: list[Rule], stats: str = "stats") -> Column:
    """The decision list as ordered conditions: false at the first rule that holds, true if none does."""
    of = features(stats)
    out = None
    for rule in rules:
        test = rule[0].column(of)
        for c in rule[1:]:
            test = test & c.column(of)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(stats: str = "stats") -> Column:
    words, repeat = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < MIN_WORDS) | (F.lit(100) * repeat > F.lit(MAX_REPEAT_PERCENT) * words)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Learn the list from at most ``rows`` labelled documents, chosen by a hash of their id.

    Rows that fail the base rules are not learned from: the list judges what
    the base rules let pass.
    """
    chosen = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    chosen = C.hashed_sample(chosen, F.col("doc_id"), rows)
    known = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``rows``
             .transform(with_statistics).where(~base_failed()))
    table = (known.select("doc_id", "quality", *[v.alias(k) for k, v in features().items()])
             .groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ["quality", *features()]])  # repeated rows count once, so ``rows`` bounds it
             .toPandas().sort_values("doc_id", kind="stable"))
    if table["quality"].nunique() < 2:
        return []
    return learn({k: table[k].to_numpy() for k in features()}, (table["quality"] == 0).to_numpy())


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with ``stats``, ``base_failed`` and ``kept``."""
    return (with_statistics(docs, text).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and verdict of every document."""
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, C.read_table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in COUNTS], "base_failed", "kept")
