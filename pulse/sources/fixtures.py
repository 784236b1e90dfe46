"""Views over the driver's tables that play the reference's inputs.

Each view is a lazy DataFrame over the parquet files in ``sf_dir``; the SQL
oracle (``pulse.plans.oracle``) builds the same views in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sentiment_of(quality, toxic):
    """(quality, toxic) -> class: (1,0) Positive, (0,1) Negative,
    (0,0) Neutral, (1,1) Irrelevant; anything else (no label) NULL."""
    q, t = F.col(quality), F.col(toxic)
    return (F.when((q == 1) & (t == 0), "Positive")
            .when((q == 0) & (t == 1), "Negative")
            .when((q == 0) & (t == 0), "Neutral")
            .when((q == 1) & (t == 1), "Irrelevant"))


def one_label(labels: DataFrame) -> DataFrame:
    """One label row per document: the smallest (quality, toxic) pair.

    The driver's labels already hold one row per doc_id, so this selects the
    same rows; stating it as a grouping lets Catalyst know doc_id is unique
    on this side, and it then removes the left join from every query that
    uses no label column (text-only queries never join or shuffle for it).
    The pair is packed into one number, NULL as the smallest value of each
    half, which a hash aggregate can take the least of (a struct cannot)."""
    half = lambda c: F.coalesce(F.col(c).cast("long") + F.lit(1 << 30), F.lit(0))
    pair = half("quality") * F.lit(1 << 32) + half("toxic")
    best = labels.groupBy("doc_id").agg(F.min(pair).alias("l"))
    back = lambda x: (F.nullif(x, F.lit(0)) - F.lit(1 << 30)).cast("int")
    return best.select("doc_id", back(F.shiftright("l", 32)).alias("quality"),
                       back(F.col("l").bitwiseAND(F.lit((1 << 32) - 1))).alias("toxic"))


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents left join labels: tweet_id, entity, sentiment, tweet_content, lang.

    The join is left so unlabelled documents stay with a NULL class. Spark
    picks the strategy: a broadcast hash join only while the labels side is
    under the broadcast threshold (AQE checks runtime sizes), else a shuffled
    join on doc_id.
    """
    docs = table(spark, sf_dir, "documents")
    labels = one_label(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return (docs.join(labels, "doc_id", "left")
            .select(F.col("doc_id").alias("tweet_id"),
                    F.col("source").alias("entity"),
                    sentiment_of("quality", "toxic").alias("sentiment"),
                    F.col("text").alias("tweet_content"),
                    F.col("lang")))


def tweets_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tweets with a hashtag of the entity and the language, a mention and a
    link appended, so markup operators have something to act on."""
    t = tweets(spark, sf_dir)
    tagged = F.concat(F.col("tweet_content"), F.lit(" #"), F.upper("entity"),
                      F.lit(" #"), F.col("lang"), F.lit(" @u"), F.col("tweet_id").cast("string"),
                      F.lit(" http://ex.org/"), F.col("tweet_id").cast("string"))
    return t.withColumn("tweet_content", tagged)


def raw_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tweets with the reference's CSV header names (spaces, mixed case)."""
    return tweets(spark, sf_dir).select(
        F.col("tweet_id").alias("Tweet ID"), F.col("entity").alias("Entity"),
        F.col("sentiment").alias("Sentiment"), F.col("tweet_content").alias("Tweet content"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tweets with a class (the reference drops rows with a NULL class)."""
    return tweets(spark, sf_dir).where(F.col("sentiment").isNotNull())


def by_language(spark: SparkSession, sf_dir: str, english: bool) -> DataFrame:
    """tweets in English, or in any other language: the two sides of a drift
    comparison (is the opinion mix of one language different?)."""
    lang = F.col("lang")
    return tweets(spark, sf_dir).where(lang == "en" if english else lang != "en")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages: a second source with other columns
    (turn, no class, no language)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("tweet_id"), "turn", F.col("role").alias("entity"),
                    F.col("text").alias("tweet_content"))


def stream_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """events as tweets: tweet_id, entity (user), sentiment (event type),
    tweet_content (props), ts as a TIMESTAMP (session zone UTC)."""
    ev = events if events is not None else table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("tweet_id"),
                     F.col("user_id").cast("string").alias("entity"),
                     F.col("event_type").alias("sentiment"),
                     F.col("props").alias("tweet_content"),
                     F.col("ts").cast("timestamp").alias("ts"))


def messages(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """stream_events encoded as message values: even ids in contract A
    (snake_case names, epoch-second double time), odd ids in contract B
    (the simulator's names, ISO time string), every 100th id not JSON."""
    se = stream_events(spark, sf_dir, events)
    a = F.to_json(F.struct(
        F.col("tweet_id").cast("string").alias("tweet_id"),
        F.col("tweet_id").cast("string").alias("original_tweet_id"),
        F.col("entity"), F.col("sentiment"), F.col("tweet_content"),
        (F.unix_micros("ts") / F.lit(1e6)).alias("timestamp")))
    b = F.to_json(F.struct(
        F.col("tweet_id").alias("Tweet ID"), F.col("entity").alias("Entity"),
        F.col("sentiment").alias("Sentiment"), F.col("tweet_content").alias("Tweet content"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")))
    value = (F.when(F.col("tweet_id") % 100 == 0, F.concat(F.lit("not json "), F.col("tweet_id").cast("string")))
             .when(F.col("tweet_id") % 2 == 0, a)
             .otherwise(b))
    return se.select("tweet_id", value.cast("binary").alias("value"))


def region_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> nation -> region: c_custkey, r_name. nation and region are
    fixed-size (25 and 5 rows), so they are broadcast; customer grows with the
    scale factor and is left to the planner."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nr = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (cust.join(F.broadcast(nr), cust.c_nationkey == nr.n_nationkey)
            .select("c_custkey", "r_name"))


def event_class(c):
    """event type -> opinion class: error Negative; purchase, signup Positive;
    click, view Neutral."""
    c = F.col(c)
    return (F.when(c == "error", "Negative")
            .when(c.isin("purchase", "signup"), "Positive")
            .when(c.isin("click", "view"), "Neutral"))
