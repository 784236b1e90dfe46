"""Document fingerprints by spot signatures.

A spot signature is an anchor, a word that many documents have, with the chain
of the next ``CHAIN`` content words (those that are no anchors) behind it. The
signatures of a text form its fingerprint: running text between anchors counts,
menus and lists of names hardly do. Two fingerprints are alike by the Jaccard
similarity of their sets.

Anchors are counted over all documents: every word in a share of ``SHARE`` of
those that have words. A caller may give other ones, which makes fingerprints
of several corpora comparable.

Near duplicates (``near_duplicates``): sets are parted by their length, into
ranges so wide that two sets above the threshold are in one or in neighbouring
ranges. Within a pair of ranges candidates share one of their rarest signatures,
of which so many are taken that two sets above the threshold cannot miss each
other; what shares such signatures forms a bundle. Bundles are compared block by
block, each set with those of like length only, and a comparison ends where the
lengths no longer allow the threshold. Only a spanning forest of a block's links
goes on, so a large group of copies makes few rows.

Defined results: words are ``WORD`` with A-Z lower-cased. A text with words, but
no chain, takes the chains behind each of its words, as if all were anchors (the
last word stands alone). A null or empty text, or one without words, has an
empty fingerprint; two empty ones are alike (1), an empty one is unlike any
other (0). A chain at the end of a text may be shorter. The next document is the
next in order of doc_id, null ids last, rows of one id in order of their texts;
after the last comes the first, which for a single row is itself. Repeated rows
each get a row. Whole texts count; other columns are ignored; an empty table
gives no rows. Rows of one id are read by one task, one after the other.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_of, by_groups, byte_texts, cut, small_batches, texts
from .graph import components

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = re.compile(WORD_PATTERN.encode())
# An anchor is in this share of the documents, a chain has so many words.
SHARE = 0.05
CHAIN = 2
# Words whose counts a task holds before it sends them.
HELD_WORDS = 200_000
# Ranges of ids dealt to each partition: the more, the more even.
RANGES = 4
# Sets of a bundle that one task compares with each other, or with as many others.
BLOCK = 500
HASH_BYTES = 6  # of a signature in a fingerprint

COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
DEALT = pa.schema([("range", pa.int32()), ("copied", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                 ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                 ("near_next", pa.float64()), ("n_signatures", pa.int64())])
OUT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
           " near_edited double, near_next double, n_signatures long")


def words_of(text: str | bytes) -> list[bytes]:
    return WORD.findall((text if isinstance(text, bytes) else text.encode()).lower())


def common_words(docs: DataFrame, share: float = SHARE) -> frozenset[bytes]:
    """The words in a ``share`` of the documents that have words, counted over
    all of them: at most (words of a document) / share, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for b in batches:
            for text in byte_texts(b.column("text")):
                count.update(set(words_of(text)))
                if len(count) >= HELD_WORDS:
                    yield batch_of(COUNTS, [list(count), list(count.values())])
                    count.clear()
        if count:
            yield batch_of(COUNTS, [list(count), list(count.values())])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    total = texts.filter(F.col("text").rlike(WORD_PATTERN)).count()
    counts = texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(bytes(r["word"]) for r in counts.filter(F.col("n") >= share * total).collect())


def signatures(text: str | bytes, anchors: frozenset[bytes], chain: int = CHAIN) -> np.ndarray:
    """The set of a text's spot signatures as sorted hashes."""
    words = words_of(text)
    found, ahead = set(), ()
    for w in reversed(words):
        if w in anchors:
            if ahead:
                found.add(b" ".join((w, *ahead)))
        else:
            ahead = (w, *ahead[:chain - 1])
    if not found:
        found = {b" ".join(words[i:i + 1 + chain]) for i in range(len(words))}
    hashed = np.array([xxhash.xxh3_64_intdigest(s) for s in found], np.uint64)
    return np.unique(hashed >> np.uint64(64 - 8 * HASH_BYTES))


def fingerprint(spots: np.ndarray) -> str:
    """The sorted hashes, as base64 of big-endian numbers of ``HASH_BYTES``."""
    raw = spots.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES:]
    return base64.b64encode(raw.tobytes()).decode()


def spots_of(text: str) -> np.ndarray:
    """The hashes of a fingerprint."""
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, HASH_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - HASH_BYTES:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 where it cannot reach ``least``,
    which the lengths may tell at once."""
    few, many = sorted((len(a), len(b)))
    if not many:
        return 1.0
    if few < least * many:
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    j = shared / (few + many - shared)
    return j if j >= least else 0.0


def lengths_apart(n: F.Column, least: float) -> F.Column:
    """The range of a set's length: sets whose lengths differ by a factor of
    ``least`` or nearer are in one range or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(1 / least)) + F.lit(1e-9)).cast("int")


def spot_sets(docs: DataFrame, anchors: frozenset[bytes], chain: int = CHAIN) -> DataFrame:
    """doc_id, cid (names the set; equal sets have one), n, spots."""
    schema = pa.schema([("doc_id", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("spots", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [signatures(t, anchors, chain) for t in byte_texts(b.column("text"))]
            yield batch_of(schema, [b.column("doc_id"), [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets],
                                    [len(x) for x in sets], [x.view(np.int64) for x in sets]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, cid long, n long, spots array<long>")


def compared(rows: DataFrame, least: float) -> DataFrame:
    """(cid, root, links) from (unit, side, across, cid, copies, spots): the sets
    of a unit, or those of its two sides with each other, by pruned Jaccard."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("unit", sort=False):
            part = part.sort_values(["size", "cid"], kind="stable")
            sets = [np.asarray(x).view(np.uint64) for x in part["spots"]]
            n, side = part["size"].to_numpy(), part["side"].to_numpy()
            cid, copies = part["cid"].to_numpy(), part["copies"].to_numpy()
            across = bool(part["across"].iloc[0])
            root, links = list(range(len(sets))), np.zeros(len(sets), np.int64)

            def find(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x
            # Partners are no longer than 1 / least times the set itself.
            upto = np.searchsorted(n, np.floor(n / least + 1e-9), "right")
            for i in range(len(sets)):
                for j in range(i + 1, int(upto[i])):
                    if across and side[i] == side[j] or likeness(sets[i], sets[j], least) == 0.0:
                        continue
                    links[i] += copies[j]
                    links[j] += copies[i]
                    x, y = find(i), find(j)
                    if x != y:
                        root[max(x, y)] = min(x, y)
            top = [find(i) for i in range(len(sets))]
            some = links > 0
            out.append(pd.DataFrame({"cid": cid[some], "root": cid[top][some], "links": links[some]}))
        return pd.concat(out)

    return by_groups(rows.withColumn("size", F.size("spots")), "unit", run, "cid long, root long, links long", rows=4 * BLOCK)


def near_duplicates(docs: DataFrame, least: float = 0.8, anchors: frozenset[bytes] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (the least id that links of likeness ``least`` or more
    reach), n_links (documents linked to this one, those of an equal set among
    them), for every document. Documents without signatures are linked with none."""
    small_batches(docs.sparkSession)
    anchors = common_words(docs) if anchors is None else anchors
    sets = cut(spot_sets(docs, anchors))
    full = sets.filter("n > 0")
    copies = full.groupBy("cid").agg(F.count("*").alias("copies"))
    classes = cut(full.dropDuplicates(["cid"]).select("cid", "n", "spots").join(copies, "cid"))
    each = classes.select("cid", "n", F.explode("spots").alias("spot"))
    often = each.groupBy("spot").agg(F.count("*").alias("often")).filter("often > 1")
    # Of two sets above the threshold each lacks so few of the other's that among
    # so many of its rarest there is one in common.
    prefix = F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)) + 1
    rank = F.row_number().over(W.partitionBy("cid").orderBy(F.coalesce("often", F.lit(1)), "spot"))
    keys = each.join(often, "spot", "left").withColumn("rank", rank).filter((F.col("rank") <= prefix) & F.col("often").isNotNull())
    apart = lengths_apart(F.col("n"), least)
    keys = keys.select("cid", "spot", F.explode(F.array(apart, apart - 1)).alias("range"))
    first = keys.groupBy("range", "spot").agg(F.min("cid").alias("first"), F.count("*").alias("m")).filter("m > 1")
    star = keys.join(first, ["range", "spot"]).filter("cid <> first").select(F.col("cid").alias("a"), F.col("first").alias("b"))
    bundle = components(star.distinct()).select(F.col("node").alias("cid"), F.col("root").alias("bundle"))
    sizes = bundle.groupBy("bundle").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = classes.join(bundle, "cid").join(sizes, "bundle").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    units = rows.select(F.xxhash64("bundle", lo, hi).alias("unit"), F.col("mine").alias("side"), (lo != hi).alias("across"),
                        "cid", "copies", "spots")
    found = cut(compared(units, least))
    roots = components(found, "cid", "root")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = full.select("doc_id", "cid").join(roots, F.col("cid") == F.col("node"), "left").select(
        "doc_id", "cid", F.coalesce("root", "cid").alias("root"))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = named.join(ids, "root").join(copies, "cid").join(links, "cid", "left").select(
        "doc_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return out.unionByName(sets.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by the start of ``after``."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """range, copied, doc_id, text: ranges of ids, each sorted and followed by
    copies of the first rows of the next range (the last one by the first)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = RANGES * parts
    # Ids that stand in the table, so each is the first of the range it begins.
    cuts = F.percentile_approx("doc_id", F.lit([i / n for i in range(1, n)]), F.lit(max(10_000, 20 * n)))
    least, cuts, nulls = docs.agg(F.min("doc_id"), cuts, F.count_if(F.isnull("doc_id"))).first()
    starts = np.array(sorted({least, *(cuts or [])} - {None}), np.int64)
    last = len(starts) - (0 if nulls else 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = b.column("doc_id"), pa.array(texts(b.column("text")), pa.string())
            null = ids.is_null().to_numpy(zero_copy_only=False)
            plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.where(null, len(starts), np.searchsorted(starts, plain, "right") - 1)
            yield batch_of(DEALT, [at.astype(np.int32), np.zeros(len(at), bool), ids, text])
            first = null.copy()
            first[~null] = starts[at[~null]] == plain[~null]
            before = np.where(at == 0, last, at - 1)
            if first.any():
                keep = pa.array(np.flatnonzero(first))
                yield batch_of(DEALT, [before[first].astype(np.int32), np.ones(int(first.sum()), bool),
                                       ids.take(keep), text.take(keep)])

    dealt = docs.mapInArrow(deal, "range int, copied boolean, doc_id long, text string")
    return dealt.repartition(parts, "range").sortWithinPartitions("range", "copied", F.asc_nulls_last("doc_id"), "text")


def fingerprints(docs: DataFrame, anchors: frozenset[bytes] | None = None, chain: int = CHAIN) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how
    alike its own is to the edited text's and to the next document's."""
    small_batches(docs.sparkSession)
    anchors = common_words(docs) if anchors is None else anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a row whose next one is to come: range, id, text, signatures
        for b in batches:
            out = []
            for at, copied, doc, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held is None or held[0] != at:
                    held = None
                    if copied:
                        continue  # a further copy: the range is done
                spots = signatures(text, anchors, chain)
                if held is not None:
                    _, d, t, own = held
                    new = edited(t, text)
                    other = signatures(new, anchors, chain)
                    out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint(own), fingerprint(other),
                                likeness(own, other), likeness(own, spots), len(own)))
                held = None if copied else (at, doc, text, spots)
            if out:
                yield batch_of(OUT, list(zip(*out)))

    return in_order(docs).mapInArrow(run, OUT_DDL)


def report(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
