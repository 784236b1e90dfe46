"""Near-duplicate texts under one id, by edit distance.

Two texts of an id are near when their Levenshtein distance is at most
``share`` of the longer one's length. Comparing all texts of an id would be
quadratic, so candidates are found by q-grams: k edits touch at most k*q of a
text's different q-grams, so of any k*q + 1 grams of the one text the other has
at least one; with the grams of both in one common order, rarest first, each
text's first k*q + 1 must have one in common. Texts too short for that many
grams meet under a key of their own. Candidates are joined by (id, gram), which
parts the texts of a hot id by their rare grams, and are tested by length first.

That join moves a third of all grams, which is worth it for ids with many texts
only. The others' texts meet in one task per id, where pairs are tested by length
and by how often letters and pairs of letters stand in them: an edit takes away
at most one letter and two pairs of letters, and adds as many, so texts that lack
more of each other's than k edits can take are not near. Letters are counted by
their hash; what falls together can hide a difference, never make one. What is
left, and what the q-grams leave of the other ids, is measured in the same task by
a Levenshtein over bit vectors, without the beginning and end that are equal.

Equal texts of an id are one before anything else, so a group of copies counts
as one text with its number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.session import materialize

MAX_SHARE = 0.1
Q = 3
# An id with more different texts, or more letters in them, goes the way by q-grams.
MANY_TEXTS = 2000
MANY_LETTERS = 4_000_000
# Buckets of letters and of pairs of letters; pairs of texts tested in one go.
LETTERS, LETTER_PAIRS = 64, 512
AT_ONCE = 1024


def grams(text: str, q: int = Q):
    """The different q-grams of a text, in one pass of a regular expression."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def distinct_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, rows, and a key of the text, per different text of an id."""
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(
        "id IS NOT NULL AND text IS NOT NULL")
    t = named.groupBy("id", "text").agg(F.count(F.lit(1)).alias("rows"))
    return t.withColumn("key", F.md5("text")).withColumn("len", F.length("text"))


def candidates(texts: DataFrame, share: float = MAX_SHARE, q: int = Q) -> DataFrame:
    """id, a, b (keys, a < b): a superset of the near pairs, each once."""
    # The longest partner that a text of this length can have, and what it may lack.
    most = F.floor(F.lit(share) * F.floor(F.col("len") / F.lit(1.0 - share) + F.lit(1e-9)) + F.lit(1e-9))
    t = texts.select("id", "key", "len", (most * q).cast("int").alias("lost"), grams("text", q).alias("grams"))
    each = t.select("id", "key", "len", "lost", F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # The rarest lost + 1 grams of every text: an array per text, not a window.
    ranked = each.join(counts, "gram").groupBy("id", "key", "len", "lost").agg(
        F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
    sent = ranked.select("id", "key", "len", F.explode(F.slice("g", 1, F.col("lost") + 1)).alias("g")).select(
        "id", "key", "len", F.col("g.gram").alias("gram"))
    short = t.where(F.size("grams") <= F.col("lost")).select("id", "key", "len", F.lit("").alias("gram"))
    sent = sent.unionByName(short)
    a = sent.select("id", "gram", F.col("key").alias("a"), F.col("len").alias("len_a"))
    b = sent.select("id", "gram", F.col("key").alias("b"), F.col("len").alias("len_b"))
    longer = F.greatest("len_a", "len_b")
    near = F.abs(F.col("len_a") - F.col("len_b")) <= F.floor(F.lit(share) * longer + F.lit(1e-9))
    return a.join(b, ["id", "gram"]).where((F.col("a") < F.col("b")) & near).select("id", "a", "b").distinct()


def letter_counts(points: list[np.ndarray]) -> np.ndarray:
    """A row per text (as code points): its letters by bucket, then its pairs of letters."""
    out = np.zeros((len(points), LETTERS + LETTER_PAIRS), np.int32)
    for row, p in zip(out, points, strict=True):
        h = p.astype(np.uint64) * np.uint64(0x9E3779B1)
        row[:LETTERS] = np.bincount((h >> np.uint64(7)) % np.uint64(LETTERS), minlength=LETTERS)
        two = (h[:-1] * np.uint64(31) + h[1:]) >> np.uint64(5)
        row[LETTERS:] = np.bincount(two % np.uint64(LETTER_PAIRS), minlength=LETTER_PAIRS)
    return out


def _lacking(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many the one text has and the other lacks, whichever is more."""
    d = a - b
    more = np.maximum(d, 0).sum(axis=1)
    return np.maximum(more, more - d.sum(axis=1))


def _alike(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether ``bound`` edits can take the one row of letter counts to the other."""
    return ((_lacking(a[:, :LETTERS], b[:, :LETTERS]) <= bound)
            & (_lacking(a[:, LETTERS:], b[:, LETTERS:]) <= 2 * bound))


def possible(points: list[np.ndarray], share: float) -> Iterator[tuple[int, int, int]]:
    """(i, j, bound) of the pairs of texts that length and letters leave possible."""
    length = np.array([len(p) for p in points])
    counts = letter_counts(points)
    for i in range(len(points) - 1):
        bound = np.floor(share * np.maximum(length[i], length[i + 1:]) + 1e-9).astype(np.int64)
        j = np.flatnonzero(np.abs(length[i] - length[i + 1:]) <= bound)
        j = j[_alike(counts[i:i + 1], counts[j + i + 1], bound[j])]
        yield from ((i, x + i + 1, k) for x, k in zip(j.tolist(), bound[j].tolist(), strict=True))


def edits(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance of two texts as code points: Myers's bit vectors, a
    bit for each letter of the one, a step for each of the other."""
    n = min(len(a), len(b))
    unequal = np.flatnonzero(a[:n] != b[:n])
    head = int(unequal[0]) if len(unequal) else n
    unequal = np.flatnonzero(a[len(a) - n + head:][::-1] != b[len(b) - n + head:][::-1])
    tail = int(unequal[0]) if len(unequal) else n - head
    a, b = a[head:len(a) - tail].tolist(), b[head:len(b) - tail].tolist()
    if not a or not b:
        return len(a) + len(b)
    at: dict[int, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    more, less, out = every, 0, len(a)  # where the column above grows, where it falls
    for x in b:
        same = at.get(x, 0)
        zero = ((((same & more) + more) ^ more) | same | less) & every
        up = less | (every ^ (zero | more))
        down = more & zero
        if up & last:
            out += 1
        elif down & last:
            out -= 1
        up = (up << 1 | 1) & every
        more, less = (down << 1 & every) | (every ^ (zero | up)), up & zero
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _result(texts: DataFrame) -> T.StructType:
    return T.StructType([texts.schema["id"], T.StructField("a", T.StringType()), T.StructField("b", T.StringType()),
                         T.StructField("distance", T.LongType())])


def pairs_in_ids(texts: DataFrame, share: float = MAX_SHARE) -> DataFrame:
    """id, a, b (keys, a < b), distance of the near pairs, each id's texts compared in one task."""
    kind = _result(texts)

    def compare(group: pa.Table) -> pa.Table:
        keys, points = group["key"].to_pylist(), [_points(t) for t in group["text"].to_pylist()]
        out = [(*sorted((keys[i], keys[j])), d) for i, j, bound in possible(points, share) if (d := edits(points[i], points[j])) <= bound]
        a, b, d = zip(*out, strict=True) if out else ((), (), ())
        ids = group["id"].take(pa.array(np.zeros(len(out), np.int64)))
        return pa.table([ids, pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(d, pa.int64())], names=kind.names)

    return texts.select("id", "key", "text").groupBy("id").applyInArrow(compare, kind)


def measured(pairs: DataFrame, share: float = MAX_SHARE) -> DataFrame:
    """id, a, b, distance of those pairs (id, a, b, text_a, text_b) that are near."""
    kind = _result(pairs)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), AT_ONCE):
                part = b.slice(at, AT_ONCE)
                one, two = ([_points(t) for t in part.column(c).to_pylist()] for c in ("text_a", "text_b"))
                bound = np.floor(share * np.array([max(len(x), len(y)) for x, y in zip(one, two, strict=True)]) + 1e-9).astype(np.int64)
                d = np.array([edits(x, y) if ok else -1 for x, y, ok in zip(
                    one, two, _alike(letter_counts(one), letter_counts(two), bound), strict=True)], np.int64)
                near = pa.array(np.flatnonzero((d >= 0) & (d <= bound)))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(near) for c in ("id", "a", "b")), pa.array(d).take(near)], names=kind.names)

    return pairs.select("id", "a", "b", "text_a", "text_b").mapInArrow(compare, kind)


def near_pairs(texts: DataFrame, share: float = MAX_SHARE, q: int = Q, many: int = MANY_TEXTS) -> DataFrame:
    """id, a, b, distance of every near pair of ``distinct_texts``."""
    hot = texts.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("letters")).where(
        (F.col("n") > many) | (F.col("letters") > MANY_LETTERS)).select("id")
    few, lots = texts.join(hot, "id", "left_anti"), texts.join(hot, "id", "left_semi")
    sides = {s: lots.select("id", F.col("key").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"}
    both = candidates(lots, share, q).join(sides["a"], ["id", "a"]).join(sides["b"], ["id", "b"])
    return measured(both, share).unionByName(pairs_in_ids(few, share))


def near_texts(df: DataFrame, id_col: str, text_col: str, share: float = MAX_SHARE, q: int = Q) -> DataFrame:
    """One row per different text that is near another one of its id: id,
    text_md5, rows (how often it stands there), links (near texts), nearest
    (the least distance). Rows with a NULL id or text take no part; an empty
    text is near another only at share 1."""
    if not 0 <= share < 1:
        raise ValueError(f"share must be in [0, 1), got {share}")
    texts = materialize(distinct_texts(df, id_col, text_col), "texts-by-id")
    p = near_pairs(texts, share, q)
    ends = p.select("id", F.explode(F.array("a", "b")).alias("key"), "distance")
    links = ends.groupBy("id", "key").agg(F.count(F.lit(1)).alias("links"), F.min("distance").alias("nearest"))
    return links.join(texts.select("id", "key", "rows"), ["id", "key"]).select(
        "id", F.col("key").alias("text_md5"), "rows", "links", "nearest")
