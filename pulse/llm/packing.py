"""Conflict-constrained best-fit packing.

Documents become pieces of at most ``capacity`` words; pieces go into bins of
that size so that no bin holds two pieces of one source or of one group of
copies: texts equal but for case, digits and punctuation, texts whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more, and whatever such
pairs connect.

Pieces are dealt by a hash into shards of about ``shard_rows``, so that a hot
source is spread evenly and a shard fits a task at any size of the input. In a
shard, pieces are placed from the longest to the shortest. Open bins are
ordered by the room they have left and carry two bitmaps, of the sources and
of the groups in them: the search starts at the tightest bin that has room and
goes on to the next until the bitmaps of a bin admit the piece. If none does,
a new bin is opened.

With b sources, a bin holds b pieces at most; a source with a third of all
pieces needs as many bins, whatever their fill.

Defined results: a null or empty text, or one without words, has one piece of
length 0 and is a copy of equal rows alone; a null source is a source; equal rows are pieces of the same group
and go to different bins. Ties in length are placed by key. An empty table
gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, jaccard
from .graph import components

CAPACITY = 4096
SHARD_ROWS = 4096
# What makes near copies: words in a shingle, and least similarity.
SIZE, PERCENT = 5, 80
PIECES = ("doc_id long, piece int, n_pieces int, start_word long, n_words int, bin_id long, place int, source string,"
          " cluster long")


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, place) of each piece; pieces come in the order of placing.
    Sources and clusters are small numbers: they are bits of a bin's bitmaps."""
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    has_source: list[int] = []
    has_cluster: list[int] = []
    count: list[int] = []
    out = []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        s, c = 1 << s, 1 << c
        k = bisect_left(room, (n, -1))
        while k < len(room) and (has_source[room[k][1]] & s or has_cluster[room[k][1]] & c):
            k += 1
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b = capacity, len(count)
            has_source.append(0)
            has_cluster.append(0)
            count.append(0)
        has_source[b] |= s
        has_cluster[b] |= c
        out.append((b, count[b]))
        count[b] += 1
        if left > n:
            insort(room, (left - n, b))
    return out


def near_copies(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root): the plain forms that near copies connect with others, and
    the one that stands for all of them."""
    full = (sketch.filter("n > 0").join(classes.select("cid", "root"), "cid", "left")
            .select(F.coalesce("root", "cid").alias("group"), "plain").distinct())
    pairs = common.cut(full)
    least = common.cut(pairs.groupBy("group").agg(F.min("plain").alias("least"), F.count("*").alias("n"))
                       .filter("n > 1").select("group", "least"))
    return components(pairs.join(common.sent_whole(least), "group"), "plain", "least")


def pieces(sketch: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, source, cluster, piece, n_pieces, start_word, n_words, k): a row
    per piece. Words are runs without ASCII white space."""
    count = F.greatest(F.lit(1), F.ceil(F.col("n_words") / capacity)).cast("int")
    rows = sketch.select("doc_id", "source", F.col("plain").alias("cluster"), F.col("n_words").alias("n"), F.col("k1").alias("k"),
                         count.alias("n_pieces"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    start = F.col("piece").cast("long") * capacity
    return rows.withColumn("start_word", start).withColumn(
        "n_words", F.least(F.lit(capacity).cast("long"), F.col("n") - start).cast("int")).drop("n")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every piece with its bin_id and place in the bin."""
    import pandas as pd

    # One pass over the texts counts words and makes both kinds of keys.
    sketch, classes = jaccard.link(docs, SIZE, PERCENT, carry=("source",), plain=True)
    near = common.sent_whole(near_copies(sketch, classes))
    todo = pieces(sketch, capacity)
    shards = max(1, -(-todo.count() // shard_rows))
    todo = (todo.join(near, F.col("cluster") == F.col("node"), "left")
            .withColumn("cluster", F.coalesce("root", "cluster")).drop("node", "root"))
    todo = todo.withColumn("shard", F.pmod(F.xxhash64("k", "piece"), F.lit(shards)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for shard, part in pdf.groupby("shard", sort=True):
            part = part.sort_values(["n_words", "k", "piece"], ascending=[False, True, True], kind="stable")
            spots = best_fit(part["n_words"].tolist(), pd.factorize(part["source"], use_na_sentinel=False)[0].tolist(),
                             pd.factorize(part["cluster"])[0].tolist(), capacity)
            part["bin_id"] = [(int(shard) << 24) + b for b, _ in spots]
            part["place"] = [p for _, p in spots]
            out.append(part)
        return pd.concat(out)[[c.split()[0] for c in PIECES.split(", ")]]

    return common.by_groups(todo, "shard", place, PIECES, rows=shard_rows)
