"""Language identification: known words first, then ever shorter n-grams.

The model is learnt from a bounded sample of labelled documents: word counts
and counts of character n-grams (of words between two marks) per language. A
known word adds the logarithms of its relative frequency in each language. A
word that the model does not know is scored by its longest n-grams of which
any are known, from ``MAX_GRAM`` down to single letters; a word without a known
letter adds nothing. The language with the highest sum wins, and its share of
the posterior is the score.

Bounds: at most about ``FIT_ROWS`` documents in all, shared out evenly over the
languages, are read for the fit; of what stands in them more than once the model
holds the ``MAX_WORDS`` most frequent words and the ``MAX_GRAMS`` most frequent
n-grams (by count, then text): bounds of the fit, as is its sample. These go to
the driver and to the tasks; nothing else does. Whole texts are scored
where they are scanned, without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score
0, as is every text if there is nothing to learn from. Ties go to the language
that sorts first. Equal rows get equal results; documents with a null language
are scored, not learnt from; a null id hashes as no id and is learnt from.
Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FIT_ROWS = 4_000
MAX_WORDS = 100_000
MAX_GRAMS = 150_000
MAX_GRAM = 5
UNKNOWN = "und"
# Scores of unseen words kept by a task; the store is emptied when it is full.
CACHE = 200_000

WORD = re.compile(r"[^\W\d_]+")
MARK = "_"


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. What counts as a word character but is
    no letter (fractions, raised or circled digits) parts words."""
    out = []
    for w in WORD.findall(text.lower()):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    w = MARK + word + MARK
    return [w[i:i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


class Model:
    """Log frequencies per language of known words and n-grams."""

    def __init__(self, langs: list[str], words: dict[str, list[int]], parts: dict[str, list[int]]):
        self.langs = langs
        by: dict[int, dict[str, list[int]]] = {}
        for g, c in parts.items():
            by.setdefault(len(g), {})[g] = c
        self.grams: dict[str, tuple] = {}
        for some in by.values():
            self.grams.update(zip(some, map(tuple, self._logs(some).tolist()), strict=True))
        # Rows of the table: known words, then words scored by their n-grams.
        self.n_words = len(words)
        self.row = {w: i for i, w in enumerate(words)}
        self.table = np.zeros((len(words) + CACHE, max(1, len(langs))))
        if words:
            self.table[:len(words)] = self._logs(words)
        self.backed_off: dict[str, int] = {}

    def state(self) -> tuple:
        return self.langs, self.row, self.table[:self.n_words], self.grams

    @classmethod
    def of(cls, state: tuple) -> Model:
        m = cls.__new__(cls)
        m.langs, m.row, known, m.grams = state
        m.n_words, m.backed_off = len(known), {}
        m.table = np.concatenate([known, np.zeros((CACHE, max(1, len(m.langs))))])
        return m

    @staticmethod
    def _logs(counts: dict[str, list[int]]) -> np.ndarray:
        m = np.array(list(counts.values()), np.float64)
        return np.log((m + 0.5) / (m.sum(axis=0) + 0.5 * len(m)))

    def back_off(self, word: str) -> tuple:
        for n in range(MAX_GRAM, 0, -1):
            known = [self.grams[g] for g in grams(word, n) if g in self.grams]
            if known:
                # A word weighs as one, however many n-grams it has.
                return tuple(sum(x) / len(known) for x in zip(*known, strict=True))
        return (0.0,) * len(self.langs)

    def rows(self, words: list[str]) -> list[int]:
        known, seen, out = self.row.get, self.backed_off, []
        for w in words:
            i = known(w)
            if i is None:
                i = seen.get(w)
                if i is None:
                    i = seen[w] = self.n_words + len(seen)
                    self.table[i] = self.back_off(w)
            out.append(i)
        return out

    def score(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        step = CACHE // 2
        for i in range(0, len(words), step):
            if len(self.backed_off) > CACHE - step:
                self.backed_off.clear()
            total += self.table[self.rows(words[i:i + step])].sum(axis=0)
        total -= total.max()
        k = int(total.argmax())
        return self.langs[k], float(1 / np.exp(total).sum())


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Fit on ``docs`` (text, lang); rows are chosen by a hash of their text."""
    spark = docs.sparkSession
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, {})
    # Even shares; what small languages leave is not dealt out again.
    share = max(1, fit_rows // len(langs))
    parts = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1 << 30, int((1 << 30) * share / sizes[k])))])
    chosen = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(parts, F.col("lang")))
    small = {k: i for i, k in enumerate(langs)}
    schema = pa.schema([("kind", pa.int32()), ("item", pa.string()), ("lang", pa.int32()), ("n", pa.int64())])
    common.small_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: Counter = Counter()
            for text, lang in zip(common.texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                k = small[lang]
                words.update((w, k) for w in words_of(text))
            some: Counter = Counter()
            for (w, k), n in words.items():
                for size in range(1, MAX_GRAM + 1):
                    for g in grams(w, size):
                        some[(g, k)] += n
            rows = [(0, w, k, n) for (w, k), n in words.items()] + [(1, g, k, n) for (g, k), n in some.items()]
            for i in range(0, len(rows), 50_000):
                yield common.batch_of(schema, list(map(list, zip(*rows[i:i + 50_000], strict=True))))

    counts = (chosen.mapInArrow(count, "kind int, item string, lang int, n long")
              .groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))
              .groupBy("kind", "item").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"),
                                           F.sum("n").alias("n")))
    counts = common.cut(counts.filter(F.col("n") > 1))

    def top(kind: int, most: int) -> dict[str, list[int]]:
        rows = counts.filter(F.col("kind") == kind).orderBy(F.desc("n"), "item").limit(most).select("item", "by").collect()
        return {r[0]: [r[1].get(i, 0) for i in range(len(langs))] for r in rows}

    return Model(langs, top(0, max_words), top(1, max_grams))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Each document as the struct ``row``, with lang_pred and score."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model.state())
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("_text"))
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = rows.select("row").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(shared.value)
        for b in batches:
            got = [m.score(t) for t in common.texts(b.column(1))]
            yield common.batch_of(arrow, [b.column(0), [x[0] for x in got], [x[1] for x in got]])

    return rows.mapInArrow(run, schema)


def train_split(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))).drop("doc_id")


def report(docs: DataFrame, **kw) -> DataFrame:
    got = predict(docs.select("doc_id", "text"), learn(train_split(docs), **kw))
    return got.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, **kw) -> DataFrame:
    """The documents whose language could be told, with their own columns."""
    got = predict(docs, learn(train_split(docs), **kw))
    return got.filter(F.col("lang_pred") != UNKNOWN).select("row.*")
