"""Word and hashtag counts: corpus-wide top-n, per class, with stopwords.

Words are exploded next to the scan and counted with a partial aggregate, so
what crosses the shuffle is one row per (partition, word), not per token.
Top-n per class uses row_number <= n, which Spark plans with a
WindowGroupLimit before the exchange: each partition sends at most n rows per
class, so a class holding a third of the corpus costs no more to rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.text import hashtags, tokens
from pulse.streaming.windows import window_counts

# The stopword list the reference filters class words with.
STOPWORDS = [
    "the", "to", "and", "a", "i", "it", "of", "in", "is", "for", "on", "this", "that",
    "my", "you", "t", "s", "com", "me", "at", "we", "they", "he", "she", "an", "as", "be",
    "are", "was", "have", "has", "had", "will", "just", "do", "from", "by", "or", "if", "but", "so", "not", "now",
]


def exploded_words(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """One row per word occurrence (plus the ``keep`` columns)."""
    keep = keep or []
    return df.select(*keep, F.explode(tokens(text)).alias("word"))


def word_counts(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return (exploded_words(df, text, by)
            .groupBy(*by, "word").agg(F.count(F.lit(1)).alias("count")))


def windowed_words(df: DataFrame, text: str, time_col: str, every: str = "1 day",
                   watermark: str | None = None) -> DataFrame:
    """Words per period: w_start, word, count. With ``watermark`` it runs on a
    stream (append mode); the top of each period is then taken from the sink,
    as a stream cannot rank within a window."""
    return window_counts(exploded_words(df, text, [time_col]), time_col, ["word"], every, watermark).drop("w_end")


def top_words(df: DataFrame, text: str, n: int = 20) -> DataFrame:
    """The n most frequent words; ties by word ascending."""
    return (word_counts(df, text)
            .orderBy(F.col("count").desc(), F.col("word").asc()).limit(n))


def top_hashtags(df: DataFrame, text: str, n: int = 5) -> DataFrame:
    """The n most frequent hashtags, lower-cased; NULL text has none."""
    tags = (df.where(F.col(text).isNotNull())
            .select(F.explode(hashtags(text)).alias("tag"))
            .select(F.lower("tag").alias("hashtag")))
    return (tags.groupBy("hashtag").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("hashtag").asc()).limit(n))


def drop_stopwords(df: DataFrame, word: str = "word", stopwords: list[str] | None = None,
                   min_len: int = 3) -> DataFrame:
    """Remove stopwords and words shorter than ``min_len`` letters. The list
    is a literal IN set, evaluated inside codegen (no join)."""
    sw = STOPWORDS if stopwords is None else stopwords
    return df.where(~F.col(word).isin(sw) & (F.length(word) >= min_len))


def _rank(by: str) -> F.Column:  # row_number is an int; ranks are returned as bigint
    return F.row_number().over(Window.partitionBy(by).orderBy(F.col("count").desc(), F.col("word").asc()))


def top_words_by(df: DataFrame, by: str, text: str, n: int = 20, pool: int | None = None,
                 stopwords: list[str] | None = None, min_len: int = 3) -> DataFrame:
    """Top n words within each value of ``by`` (rows with NULL ``by`` or NULL
    text left out). With ``pool``: take the top ``pool`` first, then drop
    stopwords and short words, then keep n - so a class may get fewer than n.
    """
    base = df.where(F.col(by).isNotNull() & F.col(text).isNotNull())
    counts = word_counts(base, text, [by])
    if pool is None:
        return (counts.withColumn("rank", _rank(by)).where(F.col("rank") <= n)
                .select(by, F.col("rank").cast("long").alias("rank"), "word", "count"))
    pooled = counts.withColumn("_r", _rank(by)).where(F.col("_r") <= pool)
    kept = drop_stopwords(pooled, "word", stopwords, min_len)
    return (kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("_r")))
            .where(F.col("rank") <= n).select(by, F.col("rank").cast("long").alias("rank"), "word", "count"))


def word_weights(df: DataFrame, text: str, n: int = 50) -> DataFrame:
    """Word-cloud weights: the top n words with count / largest count."""
    top = top_words(df, text, n)
    biggest = top.agg(F.max("count")).scalar()
    return top.withColumn("weight", F.col("count") / biggest)
