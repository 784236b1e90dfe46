"""Quality rules with risk-controlled thresholds.

Rules score a text by symbols a word, repeated lines, repeated words, capital
letters and words that mark toxic texts. Cutoffs are not set by hand: labelled
documents are split by a hash of their text (so that copies stay together) into
a fit quarter and a holdout. Documents that fail the base rules take no part.

* The fit quarter gives, per stratum (language), a path of cutoffs: it begins
  with rejecting nothing, and each step lowers one rule's cutoff, the one that
  rejects most bad documents for each good one. It also gives the toxic words.
* On the holdout the path is tested step by step, on the documents that all
  cutoffs together reject. A step passes while the exact binomial probability of
  seeing so few good documents rejected, were the true share above ``risk``,
  stays below ``delta`` divided by the number of strata (Bonferroni). Testing
  stops at the first step that fails, which keeps the whole path at that error.

So with probability 1 - delta, in every stratum at most a share ``risk`` of the
good documents that pass the base rules is rejected by the cutoffs. A stratum
with too few labels to show that (217 good ones in the holdout, for four strata)
keeps all its documents; so does a language without labels.

The path is fitted on about ``FIT_ROWS`` labelled rows, chosen by a hash, which
come to the driver as small numbers. From the holdout only counts by (language,
step) do. The ``MAX_STRATA`` languages with most labels are strata of their own;
rarer ones with labels share one.

Defined results: a null or empty text has no words and fails the base rules; a
null language is a stratum; several labels of one document count as its worst;
equal rows get equal results; labels of unknown documents are ignored. Without
labels nothing but the base rules rejects. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "dup_lines", "repeats", "capitals", "toxic_words")
BINS = 200
MAX_STRATA = 64
FIT_ROWS = 20_000
RISK, DELTA = 0.02, 0.05
# The stratum of the rarer languages (no language: it has a blank in it).
RARE = "rare languages"

FEATURES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()),
                      ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
                      ("n_repeat_words", pa.int64()), ("bins", pa.list_(pa.int32()))])
FEATURES_DDL = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
                " n_repeat_words long, bins array<int>")

_CAPITALS = bytes(range(65, 91))
_BLANKS = b" \t\n\r\x0b\x0c"


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    # Windows are numbered exactly: pairs, then pairs of pairs, then the rest.
    width = 1
    ranks = a
    while width < size:
        step = min(width, size - width)
        left, right = ranks[:n - width - step + 1], ranks[step:n - width - step + 1 + step]
        ranks = np.unique(left * (int(ranks.max()) + 1) + right, return_inverse=True)[1]
        width += step
    again = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    if not len(again):
        return 0
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + size, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str, marks: Marks) -> tuple:
    """Counts of one text and the bin of each rule."""
    raw = text.encode()
    words = raw.split()  # splits on ASCII white space only
    n = len(words)
    chars = len(text) - sum(raw.count(b) for b in _BLANKS)
    symbols = sum(raw.count(ord(c)) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    rep = repeat_words(words)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    hits = sum(map(marks.__getitem__, words)) if marks else 0
    share = lambda x, of: min(BINS - 1, math.ceil(x * (BINS - 1) / of)) if of else 0
    bins = [share(symbols, 3 * n), share(dup, len(lines)), share(rep, n), share(capitals, chars),
            min(BINS - 1, math.ceil(1000 * hits / n)) if n else 0]
    return n, chars, symbols, dup, rep, bins


def features(docs: DataFrame, words: frozenset[bytes] = frozenset(), stems: frozenset[bytes] = frozenset()) -> DataFrame:
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(words, stems)
        for b in batches:
            rows = [measure(t, marks) for t in common.texts(b.column(2))]
            yield common.batch_of(FEATURES, [b.column(0), b.column(1), *(map(list, zip(*rows)) if rows else [[]] * 6)])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")
                       ).mapInArrow(run, FEATURES_DDL)


def good_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic, holdout): one row per labelled document. Documents
    of equal texts are on one side; of several texts under one id, the least
    hash decides."""
    worst = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter(F.col("doc_id").isNotNull())
    sides = docs.select(F.col("doc_id").cast("long"), F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(4)).alias("side"))
    both = worst.select(F.col("doc_id").cast("long"), "q", "t").join(sides, "doc_id")
    return both.groupBy("doc_id", "q", "t").agg(F.min("side").alias("side")).select(
        "doc_id", F.coalesce((F.col("q") == 1) & (F.col("t") == 0), F.lit(False)).alias("good"),
        F.coalesce(F.col("t") == 1, F.lit(False)).alias("toxic"), (F.col("side") != 0).alias("holdout"))


def sampled(labels: DataFrame, rows: int) -> DataFrame:
    """All of ``labels``, or about ``rows`` of them by a hash of their ids."""
    n = labels.count()
    return labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, rows / n) * (1 << 30))) if n else labels


PUNCTUATION = ".,;:!?\"'()#*$%&|<>"
STEMS = (4, 8)  # letters of a beginning of words


class Marks(dict):
    """1 for a word that marks toxic texts, by itself or by its beginning."""

    def __init__(self, words: frozenset[bytes] = frozenset(), stems: frozenset[bytes] = frozenset()):
        super().__init__()
        self.words, self.stems = {w.decode() for w in words}, {w.decode() for w in stems}

    def __bool__(self) -> bool:
        return bool(self.words or self.stems)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        w = word.decode().lower().strip(PUNCTUATION)
        hit = self[word] = int(w in self.words or any(w[:n] in self.stems for n in range(STEMS[0], min(STEMS[1], len(w) - 1) + 1)))
        return hit


def _marking(docs: DataFrame, labels: DataFrame, rows: int, items) -> frozenset[bytes]:
    """What stands in five toxic texts or more of the fit quarter, and is twenty
    times as common there as in good texts. ``items`` makes an array of the
    different words of a text. Everything is tested; only what passes reaches
    the driver."""
    fit = common.cut(sampled(labels.filter(~F.col("holdout") & (F.col("good") | F.col("toxic"))), rows))
    sizes = {r[0]: r[1] for r in fit.groupBy("toxic").count().collect()}
    if not sizes:
        return frozenset()
    words = F.array_distinct(F.split(F.lower("text"), r"[\s.,;:!?\"'()#*$%&|<>]+"))
    each = (docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(fit), "doc_id")
            .withColumn("w", F.explode(items(words))))
    n_toxic, n_clean = max(1, sizes.get(True, 0)), max(1, sizes.get(False, 0))
    per = each.filter("w <> ''").groupBy("w").agg(F.count_if("toxic").alias("k"), F.count_if(~F.col("toxic")).alias("clean"))
    found = per.filter((F.col("k") >= 5) & (F.col("k") * n_clean >= 20 * n_toxic * (F.col("clean") + 1))).select("w")
    return frozenset(r[0].encode() for r in found.collect())


def toxic_words(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> frozenset[bytes]:
    """Words that mark toxic texts."""
    return _marking(docs, labels, rows, lambda words: words)


def toxic_stems(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> frozenset[bytes]:
    """Beginnings of longer words that mark toxic texts, whatever their endings."""
    lo, hi = STEMS
    return _marking(docs, labels, rows, lambda words: F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(
        F.filter(F.array(*[F.lit(n) for n in range(lo, hi + 1)]), lambda n: n < F.length(w)), lambda n: F.substring(w, F.lit(1), n))))))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, exactly summed."""
    if k >= n:
        return 1.0
    i = range(k + 1)
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
            for j in i]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def choose_level(errors: list[tuple[float, int]], n: int, risk: float, delta: float) -> float:
    """The largest level of a fixed sequence that passes; 0 if none does.
    errors: (level, good holdout documents that it rejects), by level."""
    best = 0.0
    for level, k in errors:
        if n == 0 or binomial_tail(k, n, risk) > delta:
            break
        best = level
    return best


def choose_steps(good: np.ndarray, bad: np.ndarray) -> list[tuple[int, int]]:
    """Steps (rule, cutoff), the best first. good and bad hold the bins of the fit
    documents, a row each. A step lowers one rule's cutoff to a bin that some bad
    document not yet rejected has: that with most of them to a good one newly
    rejected (counted one up), then with most of them, then of the first rule and
    the highest cutoff."""
    path = []
    while len(bad):
        best = None
        for j in range(good.shape[1]):
            for x in np.unique(bad[:, j])[::-1].tolist():
                if x == 0:
                    continue  # all documents
                b, g = int((bad[:, j] >= x).sum()), int((good[:, j] >= x).sum())
                if best is None or (b / (g + 1), b) > best[:2]:
                    best = (b / (g + 1), b, j, x)
        if best is None:
            break
        _, _, j, x = best
        path.append((j, x))
        good, bad = good[good[:, j] < x], bad[bad[:, j] < x]
    return path


def fit_path(good: np.ndarray, bad: np.ndarray) -> list[tuple[int, int]]:
    """The chosen steps, each led up to by all milder cutoffs of its rule: a step
    that goes too far on the holdout then stops the path late. Chosen steps that
    reject the same good documents are walked side by side, the mildest cutoffs
    first, so that one of them does not keep the others from their turn."""
    path, cut = [], np.full(len(RULES) if not len(bad) else bad.shape[1], BINS)
    reached, lost = cut.copy(), 0

    def walk():
        path.extend((j, y) for y in range(BINS - 1, 0, -1) for j in range(len(cut)) if cut[j] <= y < reached[j])
        reached[:] = np.minimum(reached, cut)
    for j, x in choose_steps(good, bad):
        new = cut.copy()
        new[j] = min(new[j], x)
        now = int((good >= new).any(axis=1).sum()) if len(good) else 0
        if now != lost:
            walk()
            lost = now
        cut[:] = new
    walk()
    return path


def first_steps(path: list[tuple[int, int]], rules: int = len(RULES), bins: int = BINS) -> np.ndarray:
    """Per rule and bin the first step (from 1) that rejects it; beyond the path
    where none does."""
    first = np.full((rules, bins), len(path) + 1)
    for s, (j, x) in reversed(list(enumerate(path, 1))):
        first[j, x:] = s
    return first


def calibrate(scored: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA,
              fit_rows: int = FIT_ROWS) -> list[tuple]:
    """(stratum, least rejected bin of each rule) rows, for every language with
    labels; a null stratum stands for a null language."""
    seen = common.cut(scored.filter(~F.col("base_failed")).join(labels, "doc_id").select("doc_id", "lang", "bins", "good", "holdout"))
    langs = [r[0] for r in seen.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    named = set(langs[:MAX_STRATA])
    stratum_of = {x: x if x in named else RARE for x in langs}
    fit: dict = {}
    for r in sampled(seen.filter("NOT holdout"), fit_rows).select("lang", "bins", "good").collect():
        fit.setdefault(stratum_of[r["lang"]], ([], []))[0 if r["good"] else 1].append(r["bins"])
    every = [[x for f in fit.values() for x in f[i]] for i in (0, 1)]

    def as_bins(rows):
        return np.array(rows, np.int64).reshape(len(rows), len(RULES))

    paths = {}
    for s in {*stratum_of.values()}:
        good, bad = fit.get(s, ([], []))
        # A stratum without bad documents to learn from takes the path of all.
        paths[s] = fit_path(as_bins(good), as_bins(bad)) if bad else fit_path(*map(as_bins, every))
    steps = {s: first_steps(p).tolist() for s, p in paths.items()}

    def rejected_at(frames):
        for pdf in frames:
            out = Counter()
            for lang, bins in zip(pdf["lang"], pdf["bins"], strict=True):
                s = stratum_of[None if lang is None or lang != lang else lang]
                out[(s, min(steps[s][j][x] for j, x in enumerate(bins)))] += 1
            import pandas as pd
            yield pd.DataFrame([(s, m, n) for (s, m), n in out.items()], columns=["stratum", "step", "n"])

    rows = (seen.filter("good AND holdout").select("lang", "bins").mapInPandas(rejected_at, "stratum string, step long, n long")
            .groupBy("stratum", "step").agg(F.sum("n").alias("n")).collect())
    by: dict = {s: Counter() for s in paths}
    for r in rows:
        by[r["stratum"]][r["step"]] += r["n"]
    cuts = {}
    for s, counts in by.items():
        path, below = paths[s], 0
        errors = []
        for step in range(1, len(path) + 1):
            below += counts[step]
            errors.append((step, below))
        last = int(choose_level(errors, sum(counts.values()), risk, delta / len(by)))
        cuts[s] = [min((x for i, x in path[:last] if i == j), default=BINS) for j in range(len(RULES))]
    return [(x, cuts[stratum_of[x]]) for x in langs]


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Every document with its counts, base_failed and kept."""
    spark = docs.sparkSession
    known = common.cut(good_labels(docs, labels))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = common.cut(features(docs, toxic_words(docs, known), toxic_stems(docs, known)).withColumn("base_failed", base))
    cuts = calibrate(scored, known, risk, delta)
    # A row per language with labels.
    table = common.sent_whole(common.cut(spark.createDataFrame(cuts, "stratum string, cuts array<int>")))
    over = F.exists(F.zip_with("bins", F.coalesce("cuts", F.array(*[F.lit(BINS)] * len(RULES))), lambda b, c: b >= c), lambda x: x)
    return (scored.join(table, F.col("lang").eqNullSafe(F.col("stratum")), "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & ~over).alias("kept"), "bins"))


def report(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    return judge(docs, labels, **kw).drop("bins")
