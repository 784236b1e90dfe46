"""Dictionaries as tables: synonyms and stopwords of any size.

A literal map or list in an expression is copied into every task's code and
stops working at some thousands of entries. Here the dictionary is a table that
is joined by word. Words that stand everywhere (a third of all positions may be
one word) would meet in one task; so positions are drawn before the join, and
both sides carry a salt: the dictionary once per salt, each position one of
them. What comes back per row is only its replacements, so a text moves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.draws import pick, uniform
from pulse.functions.text import words as split_words
from pulse.operators import augment as au
from pulse.operators.words import word_counts

SALTS = 8


def _drawn_phrases(df: DataFrame, text: str, key: Column, row: Column, p: float, seed: int, copy: int, longest: int) -> DataFrame:
    """(_key, _row, pos, n, phrase) of every run of 1 to ``longest`` words that
    starts at a drawn position. The words become rows before the draw: an
    expression inside a lambda is interpreted for each element, on rows it is
    compiled with the scan."""
    # Below the explode, so that a text is hashed once and not for each of its words.
    each = df.where(F.col(text).isNotNull()).select(key.alias("_key"), row.alias("_row"), F.col(text).alias("_text"))
    ws = split_words("_text")
    held = each.select("_key", "_row", *([ws.alias("_words")] if longest > 1 else []), F.posexplode(ws).alias("pos", "_word"))
    drawn = held.where(uniform(seed, F.col("_row"), copy, F.col("pos"), "syn") < F.lit(p))
    if longest == 1:
        return drawn.select("_key", "_row", "pos", F.lit(1).alias("n"), F.col("_word").alias("phrase"))
    runs = F.array(*[F.when(F.col("pos") + n <= F.size("_words"), F.struct(
        F.lit(n).alias("n"), F.array_join(F.slice("_words", F.col("pos") + 1, F.lit(n)), " ").alias("phrase"))) for n in range(1, longest + 1)])
    return drawn.select("_key", "_row", "pos", F.explode(runs).alias("r")).where("r IS NOT NULL").select("_key", "_row", "pos", "r.*")


def _without_overlaps(found: Column) -> Column:
    """Of replacements sorted by (pos, longest first), those that start behind
    the end of the one kept before."""
    empty = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<pos:int,shorter:int,choice:string>>").alias("kept"))
    return F.aggregate(found, empty, lambda s, f: F.when(f["pos"] >= s["free"], F.struct(
        (f["pos"] - f["shorter"]).alias("free"), F.concat(s["kept"], F.array(f)).alias("kept"))).otherwise(s), lambda s: s["kept"])


def replace_listed(df: DataFrame, text: str, id_col: str, table: DataFrame, p: float, seed: int, copy: int = 0,
                   longest: int = 1, salts: int = SALTS, out: str = "augmented") -> DataFrame:
    """Add ``out``: the text with phrases that are a ``phrase`` of ``table``
    replaced, with probability p, by one of their ``options`` (an array), words
    re-joined by one space. Draws are those of ``augment.replace_synonyms``, so a
    dictionary of single words gives what the literal map gives. Phrases have up
    to ``longest`` words; of overlapping ones the first stands, of those that
    start together the longest. NULL text stays NULL; a phrase listed several
    times has all its options, in the order of their texts; a NULL phrase, or one
    without options, replaces nothing. Rows that share an id and a text are one
    text and get one result."""
    row = F.col(id_col)
    key = F.md5(F.concat_ws("|", row.cast("string"), F.col(text)))
    ws = split_words(text)
    spots = _drawn_phrases(df, text, key, row, p, seed, copy, longest)
    spots = spots.withColumn("salt", F.pmod(F.xxhash64("_key", "pos"), F.lit(salts)))
    listed = (table.where(F.col("phrase").isNotNull()).select("phrase", F.explode("options").alias("o")).where(F.col("o").isNotNull())
              .groupBy("phrase").agg(F.sort_array(F.collect_set("o")).alias("options"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))))
    chosen = F.element_at("options", pick(F.size("options"), seed, F.col("_row"), copy, F.col("pos"), "syn_pick") + 1)
    hits = spots.join(listed, ["phrase", "salt"]).select(
        "_key", F.struct("pos", (-F.col("n")).alias("shorter"), chosen.alias("choice")).alias("f"))
    found = F.sort_array(F.collect_set("f"))  # single words cannot overlap
    per_row = hits.groupBy("_key").agg((found if longest == 1 else _without_overlaps(found)).alias("_found"))
    # The words are bound once: an expression inside a lambda runs for each element.
    joined = df.withColumn("_key", key).join(per_row, "_key", "left")
    end = lambda f: f["pos"] - f["shorter"]

    def rebuilt(w, found):
        """The words between the replacements, and those, in one pass."""
        def piece(f, i):
            start = F.when(i == 0, F.lit(0)).otherwise(end(F.element_at(found, i)))
            return F.concat(F.slice(w, start + 1, f["pos"] - start), F.array(f["choice"]))
        tail = end(F.element_at(found, -1))
        return F.concat(F.flatten(F.transform(found, piece)), F.slice(w, tail + 1, F.size(w) - tail))
    new = au.let(ws, lambda w: F.when(F.col("_found").isNull(), w).otherwise(rebuilt(w, F.col("_found"))))
    return joined.withColumn(out, F.array_join(new, " ")).drop("_key", "_found")


def count_unlisted(df: DataFrame, text: str, stopwords: DataFrame, by: list[str] | None = None, min_len: int = 3) -> DataFrame:
    """Words of at least ``min_len`` letters that are no ``word`` of the table,
    with their counts (per ``by``). Counted first: the anti-join then sees each
    word once (per ``by``), however frequent it is."""
    counts = word_counts(df, text, by).where(F.length("word") >= min_len)
    return counts.join(stopwords.select("word").where(F.col("word").isNotNull()).distinct(), "word", "left_anti")
