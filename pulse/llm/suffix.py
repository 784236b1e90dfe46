"""Removal of long repeated strings by column-wise suffix sorting.

Every byte that lies in a string of ``k`` bytes which also starts anywhere else
in the collection is removed. Suffixes are sorted the column-wise way: in each
round every string of a collection gets one more symbol in front, the symbols
in the order of the suffixes sorted so far are the new part of the collection's
Burrows-Wheeler transform, a stable sort by them gives the next order, and the
common prefixes of neighbours follow from the ones before. The symbols are read
from an external file, column after column. A string of k bytes is repeated
where a neighbour's common prefix reaches k.

Whole documents need as many rounds as the longest has bytes, and one
collection that no machine holds, so the work is dealt out first:

1. Every window of k bytes is named by its anchor, the m bytes in it with the
   least hash. Runs of windows with one anchor are cut out as strings of at
   most 2k - m bytes; equal windows always have equal anchors. Anchors that
   occur once are dropped before any text is moved.
2. Equal strings of an anchor are counted as one; two or more repeat wholly.
3. The other strings of an anchor, laid over each other at the anchor, form a
   collection, which is sorted in 2k - m rounds. Windows can be equal only
   where they start in the same column, so each round orders only the suffixes
   of its own column. Common prefixes are exact, no hash decides here.
4. An anchor with more than ``LIMIT`` different strings (a passage in very many
   documents) is parted by the bytes that neighbouring windows share, and, where
   that is still too much, window by window, which leaves equal windows to be
   counted.

Defined results: a null text is empty; texts shorter than k lose nothing. Equal
rows are copies and lose everything that is k bytes or longer. Null ids are
kept. An empty table gives no rows. Other columns are ignored, and kept by
``without_repeats``, which keeps characters whole: one that is only partly
covered stays.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 400
M = 200
LIMIT = 1000
STEP = 25
# Bytes of text whose windows are named in one go.
SLICE = 1 << 19

_U = np.uint64
_BYTE = common.mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Hasher:
    """Hashes of any substring of a slice, from sums over its prefixes."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, self.base, _U)]))
            self.down = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, self.back, _U)]))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * self.up[:len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start, end) -> np.ndarray:
        return common.mix64((sums[end] - sums[start]) * self.down[start])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    n = len(x)
    pad = np.concatenate([x, np.full(-n % w + w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


class Anchors:
    """Cuts texts into runs of windows with one anchor."""

    def __init__(self, k: int, m: int):
        self.k, self.m = k, m
        self.first, self.second = (Hasher(b) for b in _BASES)

    def slices(self, lengths: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
        """Groups of (text, start, end) pieces of about SLICE bytes; pieces of
        a longer text overlap by k - 1 bytes, so that no window is lost."""
        held, size = [], 0
        for i, n in enumerate(lengths.tolist()):
            if n < self.k:
                continue
            for s in range(0, n - self.k + 1, SLICE):
                e = min(n, s + SLICE + self.k - 1)
                held.append((i, s, e))
                size += e - s
                if size >= SLICE:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def runs(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, start, windows, anchor's offset, anchor, whole) arrays: the
        runs, with hashes of the anchor and of the whole string."""
        k, m = self.k, self.m
        for parts in self.slices(np.array([len(t) for t in texts])):
            data = np.frombuffer(b"".join(texts[i][s:e] for i, s, e in parts), np.uint8)
            base = np.cumsum([0] + [e - s for _, s, e in parts])
            sums = self.first.sums(data)
            at = np.arange(len(data) - m + 1)
            h = self.first.of(sums, at, at + m)
            bits = _U(int(len(h)).bit_length())
            least = sliding_least((h >> bits << bits) | at.astype(_U), k - m + 1)
            anchor = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
            n_windows = np.diff(base) - k + 1
            part = np.repeat(np.arange(len(parts)), n_windows)
            i = np.arange(n_windows.sum()) + (base[:-1] - np.concatenate([[0], np.cumsum(n_windows)[:-1]]))[part]
            a = anchor[i]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])]))
            count = np.diff(np.concatenate([new, [len(i)]]))
            start, a, part = i[new], a[new], part[new]
            whole = self.second.sums(data)
            text = np.array([p[0] for p in parts])[part]
            skip = np.array([p[1] for p in parts])[part] - base[part]
            yield (text, start + skip, count, a - start, h[a].view(np.int64),
                   self.second.of(whole, start, start + count + k - 1).view(np.int64))


RUNS = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                  ("start", pa.int64()), ("shape", pa.int32())])
# shape: windows and the anchor's offset in one number.
SHAPE = 1 << 12


def keyed(docs: DataFrame) -> DataFrame:
    k1, k2 = common.row_key(F.col("doc_id"), F.col("text"))
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def cut_runs(docs: DataFrame, k: int, m: int) -> DataFrame:
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(k, m)
        for b in batches:
            k1, k2 = (np.asarray(b.column(j)) for j in (0, 1))
            for text, start, count, offset, anchor, whole in anchors.runs(common.byte_texts(b.column(2))):
                yield common.batch_of(RUNS, [anchor, whole, k1[text], k2[text], start,
                                             (count * SHAPE + offset).astype(np.int32)])

    return docs.mapInArrow(run, "anchor long, whole long, k1 long, k2 long, start long, shape int")


def column_rounds(texts: list[bytes], anchor_at: np.ndarray, group: np.ndarray, k: int, m: int) -> np.ndarray:
    """For each string, by offset of its anchor (0 to k - m), whether the window
    that starts there is repeated in its group. Groups come sorted."""
    n, left, width = len(texts), k - m, 2 * k - m
    length = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    out = np.zeros((n, left + 1), bool)
    with tempfile.TemporaryFile() as columns:
        # Column c holds the symbols c - left bytes after the anchor's start;
        # 256 stands for no symbol. The last column is written, and read, first.
        for c in range(width - 1, -1, -1):
            at = anchor_at + (c - left)
            inside = (at >= 0) & (at < length)
            symbol = np.full(n, 256, np.uint16)
            symbol[inside] = data[first[inside] + at[inside]]
            symbol.tofile(columns)
        columns.seek(0)
        order = np.arange(n)
        rank = np.unique(group, return_inverse=True)[1].astype(np.int64) * 257
        common_prefix = np.zeros(n + 1, np.int32)  # with the suffix before; 0 at the ends
        for c in range(width - 1, -1, -1):
            symbol = np.frombuffer(columns.read(2 * n), np.uint16)[order]
            key = rank[order] + symbol  # groups keep their places, so rank is sorted
            place = np.argsort(key, kind="stable")
            key, order = key[place], order[place]
            same = np.concatenate([[False], (key[1:] == key[:-1]) & (symbol[place][1:] != 256)])
            # Least common prefix between the old places of neighbours.
            hi = place[same]
            lo = place[np.flatnonzero(same) - 1] + 1
            span = hi - lo + 1
            fresh = np.zeros(n + 1, np.int32)
            if len(span):
                level = np.frexp(span.astype(np.float64))[1] - 1
                got = np.empty(len(span), np.int32)
                table = common_prefix[:n]
                for p in range(int(level.max()) + 1):
                    if p:
                        half = 1 << (p - 1)
                        table = np.minimum(table[:len(table) - half], table[half:])
                    now = level == p
                    if now.any():
                        got[now] = np.minimum(table[lo[now]], table[hi[now] - (1 << p) + 1])
                fresh[:n][same] = got + 1
            common_prefix = fresh
            if c <= left:
                out[order, left - c] = np.maximum(common_prefix[:n], common_prefix[1:]) >= k
    return out


def _flag_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


PARTS = pa.schema([("unit", pa.int64()), ("anchor", pa.int64()), ("whole", pa.int64()), ("first", pa.int32()),
                   ("at", pa.int32()), ("crowded", pa.bool_()), ("string", pa.binary())])
PARTS_DDL = "unit long, anchor long, whole long, first int, at int, crowded boolean, string binary"
FOUND_DDL = "anchor long, whole long, first int, count int"


def fetch(docs: DataFrame, strings: DataFrame, k: int) -> DataFrame:
    """The bytes of ``strings``; of crowded ones, the parts whose windows start
    within ``STEP`` columns, named by the bytes that all of those share."""
    import xxhash

    per = strings.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("start", "shape", "anchor", "whole", "crowded")).alias("runs"))
    rows = docs.join(per, ["k1", "k2"]).select("text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, runs in zip(common.byte_texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                out = []
                for r in runs:
                    count, offset = divmod(r["shape"], SHAPE)
                    s = text[r["start"]:r["start"] + count + k - 1]
                    if not r["crowded"]:
                        out.append((r["anchor"], r["anchor"], r["whole"], 0, offset, False, s))
                        continue
                    i = 0
                    while i < count:
                        q = (offset - i) // STEP  # windows whose anchor is q * STEP bytes in, or little more
                        upto = min(count, offset - q * STEP + 1)
                        shared = s[max(0, offset - q * STEP):offset - q * STEP - STEP + 1 + k]
                        unit = xxhash.xxh3_64_intdigest(shared, r["anchor"] & ((1 << 64) - 1) ^ q) - (1 << 63)
                        out.append((unit, r["anchor"], r["whole"], i, offset - i, True, s[i:upto + k - 1]))
                        i = upto
                if out:
                    yield common.batch_of(PARTS, list(map(list, zip(*out, strict=True))))

    # Equal rows of the table send a string twice: it has copies anyway.
    return rows.mapInArrow(run, PARTS_DDL)


def repeated_windows(parts: DataFrame, k: int, m: int, limit: int) -> DataFrame:
    """(anchor, whole, first, count): runs of repeated windows of the strings."""
    import pandas as pd

    # Counts are partial sums joined back: a unit, or a window, in very many
    # places is no group, and a join's skewed partitions can be split.
    crowds = parts.groupBy("unit").count().filter(F.col("count") > limit).select("unit")
    crowds = common.sent_whole(common.cut(crowds))

    def rounds(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf[pdf["unit"].duplicated(keep=False)]
        if pdf.empty:
            return pd.DataFrame(out, columns=["anchor", "whole", "first", "count"])
        strings = pdf["string"].tolist()
        at = pdf["at"].to_numpy().astype(np.int64)
        flags = column_rounds(strings, at, pdf["unit"].to_numpy(), k, m)
        for anchor, whole, first, a, s, f in zip(pdf["anchor"], pdf["whole"], pdf["first"], at, strings, flags, strict=True):
            # Windows from first to last: their anchor is a, a - 1, ... bytes in.
            out += [(anchor, whole, first + x, c) for x, c in _flag_runs(f[a - (len(s) - k):a + 1][::-1])]
        return pd.DataFrame(out, columns=["anchor", "whole", "first", "count"])

    # The rest differ in a few columns only, or are equal: window by window.
    wins = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("anchor", pa.int64()), ("whole", pa.int64()), ("first", pa.int32())])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = (Hasher(b) for b in _BASES)
        for b in batches:
            for unit, anchor, whole, first, a, _, s in zip(*(c.to_pylist() for c in b.columns[:7]), strict=True):
                data = np.frombuffer(s, np.uint8)
                i = np.arange(len(s) - k + 1)
                h1, h2 = (h.of(h.sums(data), i, i + k).view(np.int64) for h in (one, two))
                yield common.batch_of(wins, [h1, h2, np.full(len(i), anchor), np.full(len(i), whole),
                                             (first + i).astype(np.int32)])

    # The small units are moved by another form of the key: by the key itself
    # Spark would leave their rows where the join put them, and adaptive
    # execution may part a unit there.
    small = parts.join(crowds, "unit", "left_anti").withColumn("unit", F.bitwise_not("unit"))
    found = common.by_groups(small, "unit", rounds, FOUND_DDL, rows=8000)
    rest = (common.cut(parts.join(crowds, "unit", "left_semi"))
            .mapInArrow(windows, "h1 long, h2 long, anchor long, whole long, first int"))
    again = common.cut(rest.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"))
    rest = rest.join(again, ["h1", "h2"]).select("anchor", "whole", "first", F.lit(1).alias("count"))
    return found.unionByName(rest)


def repeats(docs: DataFrame, k: int = K, m: int = M, limit: int = LIMIT) -> DataFrame:
    """(k1, k2, spans): byte spans (start, end) that repeat, per document that
    has any; spans may touch or overlap."""
    docs = keyed(docs)
    runs = cut_runs(docs, k, m)
    # Counted with partial sums, so that an anchor in very many places is no
    # group, and written, so that the join's skewed partitions can be split; the
    # runs are cut again for it, which costs less than moving them twice.
    again = common.cut(runs.groupBy("anchor").count().filter("count > 1").select("anchor"))
    runs = common.cut(runs.join(again, "anchor"))
    strings = common.cut(runs.groupBy("anchor", "whole", "shape").agg(
        F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "start")).alias("at")))
    # Partial sums and a join here too.
    others = common.cut(strings.groupBy("anchor").agg(F.count("*").alias("others")).filter("others > 1"))
    several = strings.join(others, "anchor").select(
        "anchor", "whole", "shape", "at.*", (F.col("others") > limit).alias("crowded"))
    parts = common.cut(fetch(docs, several, k))
    found = repeated_windows(parts, k, m, limit)
    # Strings with copies repeat wholly.
    wholly = strings.filter("copies > 1").select(
        "anchor", "whole", F.lit(0).alias("first"), F.floor(F.col("shape") / SHAPE).cast("int").alias("count"))
    found = found.unionByName(wholly)
    start = F.col("start") + F.col("first")
    spans = runs.join(found, ["anchor", "whole"]).select(
        "k1", "k2", F.struct(start.alias("start"), (start + F.col("count") - 1 + k).alias("end")).alias("span"))
    return spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def with_spans(docs: DataFrame, **kw) -> DataFrame:
    """Each document as the struct ``row`` with its text and spans."""
    k1, k2 = common.row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    return (rows.join(repeats(docs, **kw), ["k1", "k2"], "left")
            .select("row", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"), "spans"))


def report(docs: DataFrame, **kw) -> DataFrame:
    """One digest row per document, with the text that is left (parts of
    characters that a cut goes through are left out of it, not of the digest)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(common.byte_texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                spans = merged(spans)
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept = b"".join(kept) + text[at:]
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
            yield common.batch_of(schema, [b.column(0), *(map(list, zip(*out, strict=True)) if out else [[]] * 5)])

    rows = with_spans(docs.select(F.col("doc_id").cast("long"), F.col("text")), **kw)
    return rows.select("row.doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def without_repeats(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``; a column
    ``n_chars`` follows the text. Documents that lose all stay, empty; a null
    text stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for text, spans in zip(common.byte_texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                out, at = [], 0
                for s, e in merged(spans):
                    while s < e and s < len(text) and text[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
                        e -= 1
                    out.append(text[at:s])
                    at = e
                kept.append((b"".join(out) + text[at:]).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string())], names=["row", "kept"])

    rows = with_spans(docs, **kw)
    schema = rows.select("row").withColumn("kept", F.lit("")).schema
    cut_out = rows.mapInArrow(run, schema)
    new = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("kept"))
    cols = [new.alias(c) if c == "text" else
            F.coalesce(F.char_length(new), F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
            else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cut_out.select(*cols)


def brute(texts: list[bytes], k: int = K) -> list[list[tuple[int, int]]]:
    """Merged repeated spans of each text, by a table of all strings (for tests)."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - k + 1):
            seen[t[i:i + k]] = seen.get(t[i:i + k], 0) + 1
    return [merged([{"start": i, "end": i + k} for i in range(len(t) - k + 1) if seen[t[i:i + k]] > 1]) for t in texts]
