"""Exact n-gram Jaccard join by Voronoi regions of a metric space.

The distance 1 - J of shingle sets is a metric. Over a whole corpus pivots
alone cannot part it: nearly all documents are at distance 1 from nearly all
pivots, so every triangle-inequality window would take in every region. The
join therefore first finds the bundles of documents that can hold a link at
all, exactly, and pivots part those:

1. Equal sets are one class. A class sends the smallest ``t + b`` of its
   hashed shingles, where t is the most that it may lack of a partner and b a
   tenth of its size: two linked classes share at least b(smaller) of them (all
   that the one with the lower last hash sends, but t). Keys that one class
   alone sends count for nothing; classes with too few others fall away.
2. The sets of the classes that are left are read again from their texts. Now
   all their shingles count, and a class must share a whole ``percent`` of them;
   of m shared ones it needs ``need``, so it keeps only the m - need + 1 that
   the fewest classes have: in that common order, the last one that two linked
   classes share is kept by both. Classes connected by kept keys form a bundle.
3. Bundles of up to ``LIMIT`` classes are one region. A larger one gets pivots:
   every class belongs to the region of its nearest pivot and is copied to each
   region whose pivot is nearer than that distance plus twice the radius, which
   by the triangle inequality holds all its partners. Regions are cut into units
   of own and copied classes, so that no task gets an unbounded group.
4. Within a unit the same is done recursively until regions are small or the
   windows no longer part them; there sets are compared exactly. A unit gives
   a spanning forest of its links and each own class's number of links, never
   all pairs.

Set digests, and shingles, are 64-bit hashes.

Defined results: a null or empty text, or one without words, has the empty set
and links with nothing; a text of fewer words than a shingle has its whole
sequence as its only shingle. Equal documents are linked with each other. A
null id never names a component unless all ids in it are null. An empty table
gives no rows. Other columns are ignored, and kept by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .graph import components

SHARE = 10  # b is one SHARE-th of a set's size
LIMIT = 2000  # classes in a unit
PIVOTS = 8
LEAF = 64
RING = 0.05  # least width of a ring

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size
        self.seen = WordHashes()

    def __call__(self, text: bytes) -> np.ndarray:
        return self.of_all([text.translate(LOWER).split()])[0]

    def of_all(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The shingles of each text, given as its lower-cased words. Hashes of
        all texts' words are mixed at once; shingles that run from one text into
        the next are not looked at."""
        if len(self.seen) > 400_000:
            self.seen.clear()
        ends = np.cumsum([0, *map(len, texts)])
        h = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(texts)), np.uint64, int(ends[-1]))
        mixed = h[:max(0, len(h) - self.size + 1)].copy()
        for k in range(1, self.size):
            mixed = common.mix64(mixed) + h[k:len(h) - self.size + 1 + k]
        mixed = common.mix64(mixed)
        out = []
        for words, lo, hi in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if hi - lo >= self.size:
                out.append(np.unique(mixed[lo:hi - self.size + 1]))
            elif words:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def may_lack(n, percent: int):
    """The most shingles of a set of n that a linked set can lack."""
    return n - -(-percent * n // 100)


def sent(n: int, percent: int) -> int:
    return min(n, may_lack(n, percent) + max(1, -(-n // SHARE)))


# Letters in one case, digits and punctuation as spaces.
PLAIN = bytes(32 if 33 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 else b for b in LOWER)


def plain_key(text: bytes, k1: int) -> int:
    """A key of what is left of a text without case, digits and punctuation; of
    the text itself where nothing is left; of the row where there is no word."""
    words = text.decode().lower().encode().translate(PLAIN).split()
    if not words:
        words = text.split()
        if not words:
            return k1
        return xxhash.xxh3_64_intdigest(b" ".join(words), 1) - (1 << 63)
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def sketches(docs: DataFrame, size: int, percent: int, carry: tuple[str, ...] = (), plain: bool = False) -> DataFrame:
    """(doc_id, k1, k2, cid, n, n_words, keys) per document, with text columns
    of ``docs`` to ``carry`` along and, if asked for, its ``plain_key``: one pass
    over the texts."""
    common.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("cid", pa.int64()),
                        ("n", pa.int64()), ("n_words", pa.int64()), ("keys", pa.list_(pa.int64())),
                        *((c, pa.string()) for c in carry), *([("plain", pa.int64())] if plain else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for b in batches:
            cid, n, n_words, flat, ends, plains = [], [], [], [], [0], []
            texts = common.byte_texts(b.column(3))
            words_of = [t.translate(LOWER).split() for t in texts]
            for t, words, s, k1 in zip(texts, words_of, shingle.of_all(words_of), b.column(1).to_pylist(), strict=True):
                cid.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                n.append(len(s))
                n_words.append(len(words))
                flat.append(s[:sent(len(s), percent)].view(np.int64))
                ends.append(ends[-1] + len(flat[-1]))
                if plain:
                    plains.append(plain_key(t, k1))
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                            pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))
            yield common.batch_of(schema, [b.column(0), b.column(1), b.column(2), cid, n, n_words, keys,
                                           *(b.column(4 + i) for i in range(len(carry))), *([plains] if plain else [])])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), *(c.alias(k) for c, k in zip(
        common.row_key(F.col("doc_id"), F.col("text")), ("k1", "k2"), strict=True)), text.alias("text"),
        *(F.col(c).cast("string").alias(c) for c in carry))
    columns = ["doc_id long, k1 long, k2 long, cid long, n long, n_words long, keys array<long>"]
    return rows.mapInArrow(run, ", ".join(columns + [f"{c} string" for c in carry] + (["plain long"] if plain else [])))


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of (key, cid, ...) whose key more than one class has, with the
    least class of the key and the key's rows. A class sends a key once, so a
    key has at most a row for each document, whatever the documents' length."""
    w = W.partitionBy("key")
    return (keys.withColumn("least", F.min("cid").over(w)).withColumn("most", F.max("cid").over(w))
            .withColumn("rows", F.count("*").over(w)).filter("least <> most").drop("most"))


def candidates(sketch: DataFrame, percent: int) -> DataFrame:
    """The classes that share enough of the keys they send, with their number
    of documents, the key of one of them, and whether rows repeat it."""
    rows = shared_keys(sketch.filter("n > 0").select(F.explode("keys").alias("key"), "cid"))
    # Equal documents send the same keys: each counts once.
    alive = rows.groupBy("cid").agg(F.count("*").alias("m"))
    per = (sketch.filter("n > 0").groupBy("cid", "n", "k1", "k2").agg(F.count("*").alias("rows"))
           .groupBy("cid", "n").agg(F.sum("rows").alias("copies"), F.min(F.struct("k1", "k2", "rows")).alias("k")))
    # b of the smallest set that can be a partner.
    need = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * percent / 100) / SHARE))
    return common.cut(per.join(alive, "cid").filter(F.col("m") >= need * F.col("copies"))
                      .select("cid", "copies", "k.k1", "k.k2", (F.col("k.rows") > 1).alias("repeats")))


def with_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(cid, copies, shingles) of the classes, read from the texts."""
    k1, k2 = common.row_key(F.col("doc_id"), F.col("text"))
    text = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))
    rows = text.join(common.sent_whole(classes), ["k1", "k2"]).select("cid", "copies", "text", "repeats")
    # Equal rows of the table come as often as they stand there.
    rows = rows.filter("NOT repeats").union(rows.filter("repeats").dropDuplicates(["cid"]))
    schema = pa.schema([("cid", pa.int64()), ("copies", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for b in batches:
            words = [t.translate(LOWER).split() for t in common.byte_texts(b.column(2))]
            yield common.batch_of(schema, [b.column(0), b.column(1), [s.view(np.int64) for s in shingle.of_all(words)]])

    return rows.drop("repeats").mapInArrow(run, "cid long, copies long, shingles array<long>")


def bundles(members: DataFrame, percent: int) -> DataFrame:
    """(cid, bundle) of the classes that may be linked."""
    need = F.ceil(F.size("shingles") * percent / 100)
    all_keys = members.select("cid", need.alias("need"), F.explode("shingles").alias("key"))
    enough = (shared_keys(all_keys).groupBy("cid", "need").agg(F.count("*").alias("m")).filter("m >= need").select("cid"))
    # Only classes that share enough go on. Partners are among them, so what a
    # class shares with them is enough still.
    rows = shared_keys(all_keys.join(common.sent_whole(common.cut(enough)), "cid")).select("key", "cid", "need", "rows")
    # All but the need - 1 most frequent keys: the rarest m - need + 1.
    rank = F.row_number().over(W.partitionBy("cid").orderBy(F.desc("rows"), F.desc("key")))
    rows = rows.withColumn("rank", rank).filter("rank >= need").select("key", "cid")
    star = shared_keys(rows).filter("cid <> least").select(F.col("cid").alias("a"), F.col("least").alias("b")).distinct()
    return components(star).select(F.col("node").alias("cid"), F.col("root").alias("bundle"))


class Postings:
    """Postings of some sets: what others are intersected with."""

    def __init__(self, members: np.ndarray, start: np.ndarray, n: np.ndarray, ids: np.ndarray):
        self.members = members
        size = n[members]
        at = np.repeat(start[members] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        of, owner = ids[at], np.repeat(np.arange(len(members)), size)
        order = np.argsort(of, kind="stable")
        self.ids, self.owners = of[order], owner[order]

    def shared(self, mine: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of a set with the members."""
        lo, hi = np.searchsorted(self.ids, mine, "left"), np.searchsorted(self.ids, mine, "right")
        k = hi - lo
        at = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        return np.bincount(self.owners[at], minlength=len(self.members))


class Region:
    """Sets of a unit, compared with each other region by region."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.radius = percent, 1 - percent / 100
        self.n = np.array([len(s) for s in sets])
        self.ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.compared = 0  # pairs of sets that were intersected

    def _shared(self, i: int, window: Postings) -> np.ndarray:
        self.compared += len(window.members)
        return window.shared(self.ids[self.start[i]:self.start[i + 1]])

    def links(self, own: np.ndarray, every: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(i, its linked sets among ``every``) for i of ``own``, by recursive
        Voronoi regions. A region's sets are intersected only with those that its
        window lets in."""
        if len(every) > LEAF and len(own) > 1:
            both = np.union1d(own, every)
            window = Postings(both, self.start, self.n, self.ids)
            pivots = own[np.linspace(0, len(own) - 1, min(PIVOTS, len(own))).astype(int)]
            shared = np.array([self._shared(int(p), window) for p in pivots])
            d = 1 - shared / (self.n[pivots][:, None] + self.n[both][None, :] - shared)
            at_own, at_every = np.searchsorted(both, own), np.searchsorted(both, every)
            nearest, least = d.argmin(axis=0), d.min(axis=0)
            # A region falls into rings around its pivot: a partner is no farther
            # from the pivot, nor nearer to it, than the ring by more than the
            # radius, and not nearer to another pivot by more than twice of it.
            ring = (least / max(self.radius, RING)).astype(int)
            parts = []
            for j, q in sorted(set(zip(nearest[at_own].tolist(), ring[at_own].tolist()))):
                mine = own[(nearest[at_own] == j) & (ring[at_own] == q)]
                of = least[np.searchsorted(both, mine)]
                far = d[j, at_every]
                near = every[(far <= least[at_every] + 2 * self.radius + 1e-9) & (far <= of.max() + self.radius + 1e-9)
                             & (far >= of.min() - self.radius - 1e-9)]
                parts.append((mine, near))
            if sum(len(a) * len(b) for a, b in parts) < 0.7 * len(own) * len(every):
                for mine, near in parts:
                    yield from self.links(mine, near)
                return
        window = Postings(every, self.start, self.n, self.ids)
        for i in own.tolist():
            shared = self._shared(i, window)
            hit = 100 * shared >= self.percent * (self.n[i] + self.n[every] - shared)
            yield i, every[hit & (every != i)]


def join_units(rows: DataFrame, percent: int) -> DataFrame:
    """(cid, root, links) from (unit, cid, copies, own, every, shingles)."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        unit = pdf["unit"].to_numpy()
        cuts = np.flatnonzero(np.diff(unit)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(unit)], strict=True):
            part = pdf.iloc[lo:hi].drop_duplicates("cid")
            if len(part) < 2:
                continue
            cid, copies = part["cid"].to_numpy(), part["copies"].to_numpy()
            region = Region([np.asarray(s) for s in part["shingles"]], percent)
            root = list(range(len(part)))

            def find(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            count = np.zeros(len(part), np.int64)
            for i, got in region.links(np.flatnonzero(part["own"].to_numpy()), np.flatnonzero(part["every"].to_numpy())):
                count[i] += copies[got].sum()
                for x in got.tolist():
                    a, b = find(i), find(x)
                    if a != b:
                        root[max(a, b)] = min(a, b)
            top = np.array([find(x) for x in range(len(part))])
            some = (count > 0) | (top != np.arange(len(part)))
            out.append(pd.DataFrame({"cid": cid[some], "root": cid[top[some]], "links": count[some]}))
        if not out:
            return pd.DataFrame({"cid": np.empty(0, np.int64), "root": np.empty(0, np.int64), "links": np.empty(0, np.int64)})
        return pd.concat(out)

    return common.by_groups(rows, "unit", run, "cid long, root long, links long", rows=4 * LIMIT)


def in_regions(members: DataFrame, percent: int, limit: int = LIMIT) -> DataFrame:
    """Units of the bundles that are larger than a unit: Voronoi regions of
    pivots, with the classes that their windows copy, cut to size."""
    radius = 1 - percent / 100
    rank = F.row_number().over(W.partitionBy("bundle").orderBy(F.xxhash64("cid"), "cid"))
    pivots = (members.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS)
              .groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("rank", "shingles"))).alias("pivots"))
              .select("bundle", F.col("pivots.shingles").alias("pivots")))
    schema = pa.schema([("bundle", pa.int64()), ("cid", pa.int64()), ("copies", pa.int64()), ("shingles", pa.list_(pa.int64())),
                        ("cells", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for s, ps in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                mine = np.array(s)
                d = []
                for p in ps:
                    other = np.array(p)
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    d.append(1 - both / (len(mine) + len(other) - both))
                near = min(range(len(d)), key=d.__getitem__)
                # The own region first.
                cells.append([near, *(j for j, x in enumerate(d) if j != near and x <= d[near] + 2 * radius + 1e-9)])
            yield common.batch_of(schema, [*(b.column(i) for i in range(4)), cells])

    placed = common.cut(members.select("bundle", "cid", "copies", "shingles").join(pivots, "bundle")
                        .mapInArrow(run, "bundle long, cid long, copies long, shingles array<long>, cells array<int>"))
    spread = placed.select("bundle", "cid", "copies", "shingles", F.posexplode("cells").alias("place", "cell")
                           ).withColumn("own", F.col("place") == 0)
    # The sets stay where they are: only the regions' sizes are counted and joined.
    sizes = spread.groupBy("bundle", "cell").agg(
        F.ceil(F.sum(F.col("own").cast("int")) / limit).alias("n_a"), F.ceil(F.count("*") / limit).alias("n_r"))
    spread = (spread.join(common.sent_whole(common.cut(sizes)), ["bundle", "cell"]).filter("n_a > 0")
              .withColumn("a", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("n_a")))
              .withColumn("r", F.pmod(F.xxhash64("cid", F.lit(2)), F.col("n_r"))))
    unit = lambda a, r: F.xxhash64("bundle", "cell", a, r)
    as_own = (spread.filter("own").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_r") - 1)))
              .select(unit(F.col("a"), F.col("to")).alias("unit"), "cid", "copies", F.lit(True).alias("own"),
                      (F.col("to") == F.col("r")).alias("every"), "shingles"))
    as_every = (spread.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_a") - 1)))
                .filter("NOT (own AND to = a)")
                .select(unit(F.col("to"), F.col("r")).alias("unit"), "cid", "copies", F.lit(False).alias("own"),
                        F.lit(True).alias("every"), "shingles"))
    return as_own.unionByName(as_every)


def link(docs: DataFrame, size: int, percent: int, limit: int = LIMIT, carry: tuple[str, ...] = (),
         plain: bool = False) -> tuple[DataFrame, DataFrame]:
    """The documents' sketches, and (cid, root, links) of the linked classes."""
    sketch = common.cut(sketches(docs, size, percent, carry, plain))
    members = common.cut(with_sets(docs, candidates(sketch, percent), size))
    bundle = bundles(members, percent)
    n = bundle.groupBy("bundle").agg(F.count("*").alias("n_bundle"))
    members = members.join(common.sent_whole(common.cut(bundle.join(n, "bundle"))), "cid")
    yes = F.lit(True)
    units = members.filter(F.col("n_bundle") <= limit).select(
        F.col("bundle").alias("unit"), "cid", "copies", yes.alias("own"), yes.alias("every"), "shingles")
    large = members.filter(F.col("n_bundle") > limit)
    if large.limit(1).count():
        units = units.unionByName(in_regions(large, percent, limit))
    found = common.cut(join_units(units, percent))
    roots = components(found, "cid", "root")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    return sketch.drop("keys"), common.cut(roots.withColumnRenamed("node", "cid").join(links, "cid", "left"))


def report(docs: DataFrame, size: int = 3, percent: int = 90, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents linked to this
    one, copies included) of every document."""
    sketch, classes = link(docs, size, percent, limit)
    rows = sketch.join(classes, "cid", "left").select(
        "doc_id", "n", "cid", F.coalesce("root", "cid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    full = rows.filter("n > 0")
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    copies = full.groupBy("cid").agg((F.count("*") - 1).alias("copies"))
    out = (full.join(least, "root").join(copies, "cid")
           .select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("links") + F.col("copies")).alias("n_links")))
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                        F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(empty)


def drop_copies(docs: DataFrame, size: int = 5, percent: int = 80, limit: int = LIMIT) -> DataFrame:
    """One document of each component, that with the least id, and all
    documents without words; the columns of ``docs``."""
    sketch, classes = link(docs, size, percent, limit)
    full = (sketch.filter("n > 0").join(classes.select("cid", "root"), "cid", "left")
            .select(F.coalesce("root", "cid").alias("root"), F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2").alias("k")))
    stays = full.groupBy("root").agg(F.min("k").alias("stays"), F.count("*").alias("m"))
    # Rows that go: all but one of each component. Equal rows have one key, so
    # a key that stays keeps the first row of it.
    goes = common.cut(full.join(stays.filter("m > 1"), "root").filter("k <> stays").select("k.k1", "k.k2").distinct())
    twice = common.cut(full.groupBy("k.k1", "k.k2").count().filter("count > 1").select("k1", "k2"))
    k1, k2 = common.row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct("*").alias("row"))
    rows = rows.join(common.sent_whole(goes), ["k1", "k2"], "left_anti")
    few = common.sent_whole(twice)
    single = rows.join(few, ["k1", "k2"], "left_anti").select("row.*")
    repeated = rows.join(few, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
    return single.unionByName(repeated)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
    SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (
      SELECT *, least(3, len(w)) AS k FROM words WHERE len(w) > 0))),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
both_have AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
links AS (
  SELECT x, y FROM both_have JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y
  WHERE 100 * m >= 90 * (p.n + q.n - m)),
reach AS (SELECT rid AS x, rid AS y FROM words UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(l.n, 0)::BIGINT AS n_links
FROM words w LEFT JOIN sizes s USING (rid)
JOIN (SELECT x, min(o.doc_id) AS component_id FROM reach JOIN words o ON o.rid = reach.y GROUP BY x) c ON c.x = w.rid
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = w.rid"""
