"""Registered queries: one per operator of the inventory.

Each takes (spark, sf_dir) and returns a lazy DataFrame over the driver's
tables (through the views of ``pulse.sources.fixtures``). Computed columns
carry the same names as in ``pulse.plans.oracle``; doubles are rounded to 6
places on both sides so the two engines' last digits cannot differ.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.functions import text as tx
from pulse.operators import aggregates as ag
from pulse.operators import augment as au
from pulse.operators import dedup as dd
from pulse.operators import drift as dq
from pulse.operators import lexicon as lx
from pulse.operators import measures as ms
from pulse.operators import nearness as nr
from pulse.operators import resample as sa
from pulse.operators import rollup as ru
from pulse.operators import schema as sc
from pulse.operators import words as wd
from pulse.session import materialize, shared_path
from pulse.sources import files as io
from pulse.sources import fixtures as fx
from pulse.streaming import contracts as ct
from pulse.streaming import delivery as dl
from pulse.streaming import jobs as sj
from pulse.streaming import messages as sm
from pulse.streaming.windows import as_wall_clock, minute_counts as _minute_counts

SEED = 42
# Synonyms over words the driver's prose does contain (the producer's English
# keys, such as "good" or "love", occur in none of the driver's documents).
QUERY_SYNONYMS = {"the": ["a", "this", "that"], "and": ["plus", "with"]}
BASE_TIME = 1704067200.0
BATCH_COLUMNS = ["tweet_id", "entity", "sentiment", "tweet_content", "tweet_content_cleaned"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def cleaned(spark, sf):
    """The reference's batch job up to its counts: canonical names, drop rows
    with a NULL in the four columns, lower-case ascii cleaning."""
    base = dd.drop_incomplete(fx.tweets(spark, sf), ["tweet_id", "entity", "sentiment", "tweet_content"])
    return base.withColumn("tweet_content_cleaned", tx.clean_text("tweet_content"))


# ---------------------------------------------------------------- sources ---

@query
def scan_count(spark, sf):
    return fx.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------ filters, projection ---

@query
def drop_nulls(spark, sf):
    return dd.drop_incomplete(fx.tweets(spark, sf), ["tweet_id", "entity", "sentiment", "tweet_content"]) \
        .select("tweet_id", "entity", "sentiment", "tweet_content")


@query
def filter_class(spark, sf):
    return fx.tweets(spark, sf).where(F.col("sentiment") == "Positive").select("tweet_id", "entity", "lang")


# ------------------------------------------------------------ aggregates ---

@query
def count_by_sentiment(spark, sf):
    return ag.count_by(cleaned(spark, sf), "sentiment")


@query
def top_entities(spark, sf):
    return ag.top_by_count(cleaned(spark, sf), "entity", 10)


@query
def sentiment_shares(spark, sf):
    s = ag.shares(fx.tweets(spark, sf), "sentiment")
    return s.select("sentiment", "n", r6("share").alias("share"))


@query
def entity_shares(spark, sf):
    s = ag.shares(fx.tweets(spark, sf), "entity")
    return s.select("entity", "n", r6("share").alias("share"))


@query
def language_shares(spark, sf):
    s = ag.shares(fx.tweets(spark, sf), "lang")
    return s.select("lang", "n", r6("share").alias("share"))


@query
def length_stats(spark, sf):
    s = ag.length_stats(fx.tweets(spark, sf), "tweet_content")
    return s.select("count", *[r6(c).alias(c) for c in ag.LENGTH_METRICS[1:]])


@query
def column_profile(spark, sf):
    return ag.column_profile(fx.tweets(spark, sf))


# ------------------------------------------------------------------ text ---

@query
def clean_text(spark, sf):
    return cleaned(spark, sf).select("tweet_id", "tweet_content_cleaned")


@query
def clean_text_digits(spark, sf):
    t = fx.tweets(spark, sf)
    return t.select("tweet_id", tx.clean_text("tweet_content", "ascii_digits").alias("cleaned"))


@query
def strip_markup(spark, sf):
    t = fx.tweets_tagged(spark, sf)
    return t.select("tweet_id", tx.strip_markup("tweet_content").alias("stripped"))


@query
def tokenize(spark, sf):
    t = fx.tweets_tagged(spark, sf).select("tweet_id", tx.tokens("tweet_content").alias("w"))
    return t.select("tweet_id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query
def extract_hashtags(spark, sf):
    t = fx.tweets_tagged(spark, sf).select("tweet_id", tx.hashtags("tweet_content").alias("h"))
    return t.select("tweet_id", F.array_join("h", " ").alias("hashtags"))


@query
def top_words(spark, sf):
    return wd.top_words(fx.tweets(spark, sf), "tweet_content", 20)


@query
def top_hashtags(spark, sf):
    return wd.top_hashtags(fx.tweets_tagged(spark, sf), "tweet_content", 5)


@query
def top_words_by_class(spark, sf):
    return wd.top_words_by(fx.tweets(spark, sf), "sentiment", "tweet_content", n=20)


@query
def top_words_by_class_filtered(spark, sf):
    return wd.top_words_by(fx.tweets(spark, sf), "sentiment", "tweet_content", n=50, pool=200)


@query
def word_stopfilter(spark, sf):
    words = wd.exploded_words(fx.tweets(spark, sf), "tweet_content")
    return wd.drop_stopwords(words).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


@query
def word_weights(spark, sf):
    w = wd.word_weights(fx.tweets(spark, sf), "tweet_content", 50)
    return w.select("word", "count", r6("weight").alias("weight"))


# ------------------------------------------------------------ duplicates ---

def corpus(spark, sf):
    """The notebook's train + validation: all tweets, then the labelled ones
    again (a second file that repeats rows of the first)."""
    return dd.append_tables([fx.tweets(spark, sf), fx.labelled(spark, sf)])


@query
def dup_count_rows(spark, sf):
    c = corpus(spark, sf).drop("source_rank")
    return dd.duplicate_report(c, {"dup_rows": c.columns}, {"tweet_content"}).select("rows", "dup_rows")


@query
def dup_count_key(spark, sf):
    c = corpus(spark, sf)
    return dd.duplicate_report(c, {"dup_ids": ["tweet_id"], "dup_texts": ["tweet_content"]},
                               {"tweet_content"})


@query
def dedup_keep_first(spark, sf):
    kept = dd.keep_first(corpus(spark, sf), ["tweet_id"], ["source_rank"], total=True)  # ids are unique in a source
    return kept.select("tweet_id", "source_rank", "entity", "sentiment", "lang")


@query
def dedup_repeated_ids(spark, sf):
    """Keep-first where ids repeat inside a source as well as across them."""
    fold = lambda t: t.withColumn("tweet_id", F.col("tweet_id") % 97)
    both = dd.append_tables([fold(fx.tweets(spark, sf)), fold(fx.labelled(spark, sf))])
    return dd.keep_first(both, ["tweet_id"], ["source_rank"]).select(
        "tweet_id", "source_rank", "entity", "sentiment", "lang", F.md5("tweet_content").alias("text_md5"))


@query
def near_texts(spark, sf):
    """Near-duplicate texts under one id: each conversation's turns, cleaned,
    as sent four times over with small changes."""
    t = fx.turns(spark, sf).select("tweet_id", tx.clean_text("tweet_content").alias("t"))
    sent = F.array(F.col("t"), F.regexp_replace("t", "tion", "toin"), F.concat(F.lit("rt "), F.col("t")),
                   F.regexp_replace("t", "e", ""))
    return nr.near_texts(t.select("tweet_id", F.explode(sent).alias("tweet_content")), "tweet_id", "tweet_content")


@query
def union_by_name(spark, sf):
    a = fx.tweets(spark, sf).select("tweet_id", "entity", "sentiment", "lang")
    b = fx.turns(spark, sf).select("tweet_id", "turn", "entity")  # no class or language, a turn
    return dd.append_tables([a, b])


# ----------------------------------------------------------------- drift ---

@query
def drift_categories(spark, sf):
    d = dq.category_drift(fx.by_language(spark, sf, True), fx.by_language(spark, sf, False), "sentiment")
    return d.select("sentiment", r6("share_a").alias("share_a"), r6("share_b").alias("share_b"),
                    r6("diff").alias("diff"), "status")


@query
def drift_summary(spark, sf):
    d = dq.drift_summary(dq.category_drift(fx.by_language(spark, sf, True), fx.by_language(spark, sf, False),
                                           "entity"))
    return d.select("categories", r6("max_diff").alias("max_diff"), r6("mean_diff").alias("mean_diff"), "status")


@query
def drift_lengths(spark, sf):
    d = dq.numeric_drift(fx.by_language(spark, sf, True), fx.by_language(spark, sf, False), "tweet_content")
    return d.select("metric", r6("value_a").alias("value_a"), r6("value_b").alias("value_b"),
                    r6("diff_pct").alias("diff_pct"), "status")


@query
def drift_distribution(spark, sf):
    """Whole distributions of text lengths, words and tags, English against the rest."""
    words = F.size(tx.tokens("tweet_content"))
    d = dq.distribution_drift(fx.by_language(spark, sf, True), fx.by_language(spark, sf, False),
                              {"chars": tx.text_length("tweet_content"), "words": words})
    return d.select("measure", "n_a", "n_b", r6("statistic").alias("statistic"), "value_at",
                    r6("critical").alias("critical"), "status")


@query
def profile_merged(spark, sf):
    """Daily profiles of the events, written in two runs of which the second
    repeats a day, merged over twenty days: exact figures, and whether the
    estimated ones are within their bounds of the exact ones."""
    path = shared_path(spark, "daily")
    ev = wall_clock_events(spark, sf)
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (early, ~early | (F.to_date("ts") == F.lit("2024-01-15"))):
        ru.add_days(ev.where(part), path, "ts", "tweet_content", ["entity", "tweet_id"])
    merged = ru.profile_merged(spark, path, "2024-01-05", "2024-01-24").first()
    d = ev.where(F.to_date("ts").between(F.lit("2024-01-05"), F.lit("2024-01-24"))).withColumn("n", F.length("tweet_content"))
    near = lambda c, of: F.abs(F.lit(merged[f"distinct_{c}"]) - of) <= F.lit(ru.DISTINCT_ERROR) * of
    n = F.count("n")

    def ranked(c, q):
        """The share of lengths up to the estimate, and below it, hold the rank."""
        v, e = F.lit(merged[c]), F.lit(2 * ru.RANK_ERROR)
        below, upto = F.count_if(F.col("n") < v) / n, F.count_if(F.col("n") <= v) / n
        return (below <= q + e) & (upto >= q - e)
    whole = lambda c: F.lit(merged[c]).cast("long").alias(c)
    return d.agg(whole("rows"), whole("null_cells"),
                 r6(F.lit(merged["mean"])).alias("mean"), r6(F.lit(merged["std"])).alias("std"),
                 whole("min"), whole("max"),
                 near("entity", F.countDistinct("entity")).alias("entities_ok"),
                 near("tweet_id", F.countDistinct("tweet_id")).alias("ids_ok"),
                 *[ranked(c, q).alias(f"{c}_ok") for c, q in ru.QUARTILES.items()])


@query
def integrity_report(spark, sf):
    return dq.integrity_report(fx.tweets(spark, sf))


@query
def acceptance(spark, sf):
    """Acceptance of a generated table: one augmented copy of the labelled
    corpus against the corpus."""
    ref = fx.labelled(spark, sf)
    cand = au.augment(ref, 1, SEED, BASE_TIME, mapping=QUERY_SYNONYMS)
    return dq.acceptance(ref, cand).select("criterion", r6("result").alias("result"), "limit", "passed")


# ------------------------------------------------------ sources and sinks ---



def simulator_rows(spark, sf):
    """stream_events in the simulator's record layout (contract B)."""
    se = fx.stream_events(spark, sf)
    return se.select(F.col("tweet_id").alias("Tweet ID"), F.col("entity").alias("Entity"),
                     F.col("sentiment").alias("Sentiment"), F.col("tweet_content").alias("Tweet content"),
                     F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))


@query
def roundtrip_parquet(spark, sf):
    path = shared_path(spark, "batch_tweets")
    io.write_parquet(cleaned(spark, sf).select(*BATCH_COLUMNS), path)
    return io.read_parquet(spark, path)


@query
def roundtrip_csv(spark, sf):
    path = shared_path(spark, "raw_tweets_csv")
    io.write_csv(fx.raw_tweets(spark, sf), path)
    return io.read_tweets_csv(spark, path, header=True)


@query
def csv_reordered_header(spark, sf):
    """A CSV whose header names the columns in another order, with one more."""
    path = shared_path(spark, "reordered_csv")
    t = fx.raw_tweets(spark, sf)
    io.write_csv(t.select("Sentiment", F.lit("x").alias("More"), "Tweet content", "Entity", "Tweet ID"), path)
    return io.read_tweets_csv(spark, path)


@query
def csv_headerless(spark, sf):
    path = shared_path(spark, "headerless_csv")
    io.write_csv(fx.raw_tweets(spark, sf), path, header=False)
    return io.read_tweets_csv(spark, path, header=False)


@query
def csv_bad_rows(spark, sf):
    """Rows whose id is no number, kept apart as they stand."""
    path = shared_path(spark, "bad_csv")
    t = fx.raw_tweets(spark, sf)
    i = F.col("Tweet ID")
    io.write_csv(t.withColumn("Tweet ID", F.when(i % 10 == 0, F.concat(F.lit("id "), i)).otherwise(i.cast("string"))), path)
    return io.bad_csv_rows(spark, path).select(F.col("Tweet ID").alias("tweet_id"), F.col("Entity").alias("entity"))


@query
def json_array(spark, sf):
    """Files that hold one array of records each."""
    path = shared_path(spark, "json_arrays")
    io.write_json_arrays(simulator_rows(spark, sf), path, 20_000, "Tweet ID")
    return as_wall_clock(io.read_tweets_json(spark, path, multi_line=True), ["event_time"])


@query
def roundtrip_json(spark, sf):
    path = shared_path(spark, "synth_json")
    io.write_json(simulator_rows(spark, sf), path)
    back = io.read_tweets_json(spark, path)
    return as_wall_clock(back, ["event_time"])


@query
def encode_json(spark, sf):
    rows = simulator_rows(spark, sf)
    return sm.to_message_value(rows, keep={"Tweet ID": "tweet_id"})


@query
def clustered_lookup(spark, sf):
    """Events written by ranges of time, looked up by the hashes of some ids."""
    path = shared_path(spark, "clustered")
    ev = fx.table(spark, sf, "events").select("event_id", "ts", "event_type", F.md5(F.col("event_id").cast("string")).alias("hash"))
    io.write_clustered(ev, path, "ts", ["hash"], files=8, distinct=100_000)
    wanted = materialize(ev.where("event_id % 5000 = 0").select("hash").distinct(), "wanted")
    return as_wall_clock(io.lookup(io.read_parquet(spark, path), "hash", wanted), ["ts"])


@query
def bounded_sample(spark, sf):
    return io.bounded_sample(cleaned(spark, sf).select(*BATCH_COLUMNS), 1000, ["tweet_id"])


# ---------------------------------------------------------------- schema ---

@query
def project_rename(spark, sf):
    return sc.canonical(fx.raw_tweets(spark, sf))


@query
def schema_by_name(spark, sf):
    t = fx.tweets(spark, sf).select(F.col("tweet_id").alias("id"), F.col("entity").alias(" Brand"),
                                    F.col("sentiment").alias("polarity"), F.col("tweet_content").alias("text "),
                                    F.col("lang").alias("language"))
    return sc.infer_by_name(t)


def headerless(spark, sf):
    """tweets as a headerless CSV would read: _c0.._c4, all strings."""
    t = fx.tweets(spark, sf).select("tweet_id", "entity", "sentiment", "tweet_content", "lang")
    return sc.as_text(t.toDF(*[f"_c{i}" for i in range(5)]), [f"_c{i}" for i in range(5)])


@query
def schema_by_content(spark, sf):
    """Per-column content metrics and the role each column gets, one plan."""
    m = sc.with_roles(sc.content_metrics(headerless(spark, sf)))
    shown = ["digit_share", "label_share", "mean_len"]
    return m.select("position", "column", *[r6(c).alias(c) for c in shown], "n_distinct", "rows", "role")


# ------------------------------------------------------------- streaming ---

def wall_clock_events(spark, sf):
    """stream_events with ``ts`` as TIMESTAMP_NTZ: batch windows are then cut
    on wall-clock time, the same in any session time zone (days start at
    midnight of the recorded clock, not of UTC)."""
    return fx.stream_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def decode_json(spark, sf):
    d = sm.decode_messages(fx.messages(spark, sf)).select(*sm.DECODED_COLUMNS)
    return as_wall_clock(d, ["event_time"])


@query
def decode_variant(spark, sf):
    """Messages decoded by the table of contracts: as ``decode_json``."""
    return as_wall_clock(ct.decode_with(fx.messages(spark, sf)).select(*sm.DECODED_COLUMNS), ["event_time"])


@query
def unexpected_fields(spark, sf):
    """Every third message has a field more, every ninth has it as a text."""
    m = fx.messages(spark, sf).select("tweet_id", F.col("value").cast("string").alias("v"))
    i = F.col("tweet_id")
    more = F.when(i % 9 == 0, F.lit(',"retweets":"many"}')).when(i % 3 == 0, F.lit(',"retweets":7,"geo":{"lat":1.5}}')).otherwise(F.lit("}"))
    return ct.unexpected_fields(m.select(F.concat(F.rtrim("v", F.lit("}")), more).alias("value")))


@query
def rejected_messages(spark, sf):
    """What could not be decoded, with its raw value."""
    return sm.rejected(sm.decode_messages(fx.messages(spark, sf))).select("raw", "sentiment", "contract")


@query
def minute_counts(spark, sf):
    return _minute_counts(wall_clock_events(spark, sf), "ts")


def table_stream(spark, sf, name):
    return sj.table_stream(spark, f"{sf.rstrip('/')}/{name}.parquet", fx.table(spark, sf, name).schema)


@query
def stream_minute_counts(spark, sf):
    """The streaming job end to end: a file stream of events stands in for the
    topic, values are encoded and decoded, counted per minute and class with
    a 10-minute watermark, appended to Parquet with a checkpoint; the query
    drains what is there (availableNow) and the sink is read back."""
    src = table_stream(spark, sf, "events")
    counts = sj.minute_count_stream(fx.messages(spark, sf, events=src), sj.DEFAULT_WATERMARK)
    out, ck = shared_path(spark, "minute_counts"), shared_path(spark, "minute_counts_ckpt")
    q = sj.stream_to_parquet(counts, out, ck, {"availableNow": True}, state_partitions=sj.STATE_PARTITIONS)
    q.awaitTermination()
    return as_wall_clock(spark.read.parquet(out), ["w_start", "w_end"])


DAY = 86400


def texts_stream(spark, sf):
    """A file stream of documents as tagged texts with a time: tweet_content,
    ts (the day that the id gives)."""
    src = table_stream(spark, sf, "documents")
    at = F.timestamp_seconds(F.lit(BASE_TIME).cast("long") + F.col("doc_id") % 10 * DAY)
    tagged = F.concat(F.col("text"), F.lit(" #"), F.upper("source"), F.lit(" #"), F.col("lang"))
    return src.select(tagged.alias("tweet_content"), at.alias("ts"))


def drained(spark, df, name):
    """Run a streaming frame over what is there and read its sink back."""
    out, ck = shared_path(spark, name), shared_path(spark, f"{name}_ckpt")
    sj.stream_to_parquet(df, out, ck, {"availableNow": True}, state_partitions=sj.STATE_PARTITIONS).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_top_words(spark, sf):
    """Words per day on a stream, closed days only; the ten most frequent of
    each day are then taken from the sink."""
    counts = drained(spark, wd.windowed_words(texts_stream(spark, sf), "tweet_content", "ts", "1 day", "1 day"), "words")
    best = F.row_number().over(Window.partitionBy("w_start").orderBy(F.desc("count"), "word"))
    return as_wall_clock(counts.withColumn("rank", best.cast("long")).where(F.col("rank") <= 10), ["w_start"]).select(
        "w_start", "rank", "word", "count")


@query
def stream_hashtag_counts(spark, sf):
    tags = ms.hashtag_counts(texts_stream(spark, sf), "tweet_content", "ts", "1 day", "1 day")
    return as_wall_clock(drained(spark, tags, "hashtags"), ["w_start"])


@query
def stream_region_opinion(spark, sf):
    """Opinion by region and day on a stream of events."""
    src = table_stream(spark, sf, "events")
    ev = src.select("user_id", F.col("ts").cast("timestamp").alias("ts"), fx.event_class("event_type").alias("sentiment"))
    o = ms.region_opinion_over_time(ev, fx.region_dimension(spark, sf), "user_id", "sentiment",
                                    ["Positive", "Negative", "Neutral"], "ts", "1 day", "1 hour")
    shares = ["share_positive", "share_negative", "share_neutral", "mean_score"]
    return as_wall_clock(drained(spark, o, "regions"), ["w_start"]).select(
        "w_start", "r_name", "n", *[r6(c).alias(c) for c in shares])


EVENT_COLUMNS = ["tweet_id", "entity", "sentiment", "tweet_content", "event_time"]
WAVES = 3


def in_waves(spark, messages, name):
    """Messages (wave, value) written to a folder wave by wave; yields after
    each, so that a stream can be run, stopped and run again in between."""
    folder = shared_path(spark, name)
    for i in range(WAVES):
        messages.where(F.col("wave") == i).select("value").write.mode("append").parquet(folder)
        yield folder


def wave_of(at):
    """Ten days of the month each."""
    return F.least(F.floor((F.dayofmonth(at) - 1) / 10), F.lit(WAVES - 1)).cast("int")


def delivered(spark, sf):
    """Messages as a topic holds them: every fifth sent again five minutes
    later, every seventh at once; waves by the time of delivery."""
    ev = fx.table(spark, sf, "events")
    later = ev.where("event_id % 5 = 0").withColumn("at", F.col("ts") + F.expr("INTERVAL 5 MINUTES"))
    sent = ev.withColumn("at", F.col("ts")).unionByName(later).unionByName(ev.where("event_id % 7 = 0").withColumn("at", F.col("ts")))
    sent = sent.withColumn("wave", wave_of("at"))
    return reduce(lambda a, b: a.unionByName(b), [
        fx.messages(spark, sf, events=sent.where(F.col("wave") == i)).withColumn("wave", F.lit(i)) for i in range(WAVES)])


@query
def stream_keep_first(spark, sf):
    """Keep-first on a stream of repeated deliveries, stopped and started again
    between the waves: the state remembers what came before a stop."""
    out, ck = shared_path(spark, "first"), shared_path(spark, "first_ckpt")
    for folder in in_waves(spark, delivered(spark, sf), "deliveries"):
        src = sj.file_stream(spark, folder, "value binary")
        first = dl.first_deliveries(sm.accepted(sm.decode_messages(src)), watermark=sj.DEFAULT_WATERMARK)
        sj.stream_to_parquet(first.select(*EVENT_COLUMNS), out, ck, {"availableNow": True}).awaitTermination()
    return as_wall_clock(spark.read.parquet(out), ["event_time"])


@query
def stream_corrected_counts(spark, sf):
    """Minute counts of a stream in which every tenth message comes ten or
    twenty days late, far behind any watermark: the corrected table has them."""
    ev = fx.table(spark, sf, "events").withColumn("wave", wave_of("ts"))
    late = F.when(F.col("event_id") % 10 == 3, F.lit(WAVES - 1)).otherwise(F.col("wave"))
    ev = ev.withColumn("wave", late)
    sent = reduce(lambda a, b: a.unionByName(b), [
        fx.messages(spark, sf, events=ev.where(F.col("wave") == i)).withColumn("wave", F.lit(i)) for i in range(WAVES)])
    path, ck, by = shared_path(spark, "corrected"), shared_path(spark, "corrected_ckpt"), {"sentiment": "string"}
    for folder in in_waves(spark, sent, "late"):
        src = sm.accepted(sm.decode_messages(sj.file_stream(spark, folder, "value binary")))
        dl.correct_counts(src, path, ck, list(by), trigger={"availableNow": True}).awaitTermination()
    return as_wall_clock(dl.corrected(spark, path, by), ["w_start", "w_end"])


@query
def stream_open_windows(spark, sf):
    """The sink's closed windows and the state's open ones: all minute counts."""
    src = table_stream(spark, sf, "events")
    counts = sj.minute_count_stream(fx.messages(spark, sf, events=src), sj.DEFAULT_WATERMARK)
    out, ck = shared_path(spark, "closed"), shared_path(spark, "closed_ckpt")
    sj.stream_to_parquet(counts, out, ck, {"availableNow": True}, state_partitions=sj.STATE_PARTITIONS).awaitTermination()
    closed = spark.read.parquet(out).withColumn("open", F.lit(False))
    still = dl.open_windows(spark, ck, ["sentiment"]).withColumn("open", F.lit(True))
    return as_wall_clock(closed.unionByName(still), ["w_start", "w_end"])


def lineage_sides(spark, sf):
    """Messages, and copies that name them: copies of every fourth message ten
    minutes on; of every fourth plus one of a message that never was; of every
    fourth plus two three hours on, out of bounds. Two waves: the messages, and
    a heartbeat of the next month without an id, which moves the watermark."""
    ev = fx.table(spark, sf, "events")
    kind = F.col("event_id") % 4
    beat = ev.groupBy().agg(F.max("ts").alias("ts")).select(
        F.lit(None).cast("string").alias("tweet_id"), F.lit(None).cast("string").alias("original_tweet_id"),
        (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(1).alias("wave"))
    own = ev.select(F.col("event_id").cast("string").alias("tweet_id"), F.lit(None).cast("string").alias("original_tweet_id"),
                    "ts", F.lit(0).alias("wave"))
    of = F.when(kind == 1, -F.col("event_id")).otherwise(F.col("event_id")).cast("string")
    on = F.when(kind == 2, F.expr("INTERVAL 180 MINUTES")).otherwise(F.expr("INTERVAL 10 MINUTES"))
    copies = ev.where(kind < 3).select(F.concat(F.lit("c"), F.col("event_id")).alias("tweet_id"),
                                       of.alias("original_tweet_id"), (F.col("ts") + on).alias("ts"), F.lit(0).alias("wave"))

    def messages(df):
        fields = F.struct("tweet_id", "original_tweet_id", F.lit("Neutral").alias("sentiment"),
                          (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"))
        return df.select("wave", F.to_json(fields).cast("binary").alias("value"))
    return messages(copies.unionByName(beat)), messages(own.unionByName(beat))


@query
def stream_lineage(spark, sf):
    """Copies joined to their originals across two streams."""
    sides = lineage_sides(spark, sf)
    folders = [shared_path(spark, n) for n in ("copies", "originals")]
    out, ck = shared_path(spark, "lineage"), shared_path(spark, "lineage_ckpt")
    for wave in (0, 1):
        streams = []
        for df, folder in zip(sides, folders):
            df.where(F.col("wave") == wave).select("value").write.mode("append").parquet(folder)
            streams.append(sm.accepted(sm.decode_messages(sj.file_stream(spark, folder, "value binary"))))
        joined = dl.lineage(*streams, within="1 hour", watermark=sj.DEFAULT_WATERMARK)
        sj.stream_to_parquet(joined, out, ck, {"availableNow": True}).awaitTermination()
    return as_wall_clock(spark.read.parquet(out), ["copy_time", "original_time"])


BURST_GAP = "2 hours"


@query
def stream_mention_bursts(spark, sf):
    """Runs of mentions of a user on a stream, closed ones only."""
    src = table_stream(spark, sf, "events")
    bursts = ms.mention_bursts(fx.stream_events(spark, sf, events=src), "ts", "entity", BURST_GAP, 2, sj.DEFAULT_WATERMARK)
    return as_wall_clock(drained(spark, bursts, "bursts"), ["w_start", "w_end"])


# ---------------------------------------------------- augment, resample ---




def _augment_one(spark, sf, step: str, p: float):
    t = fx.tweets(spark, sf)
    kw = {"p_syn": p, "p_swap": p, "p_typo": p}
    a = au.augment_words(t, "tweet_content", "tweet_id", SEED, 0, QUERY_SYNONYMS, steps=(step,), **kw)
    return a.select("tweet_id", "augmented")


@query
def augment_synonyms(spark, sf):
    return _augment_one(spark, sf, "syn", au.P_SYNONYM)


@query
def augment_from_table(spark, sf):
    """Synonyms from a table: every word of the benchmark, in two forms."""
    words = fx.table(spark, sf, "benchmark").select(F.explode(tx.words("text")).alias("phrase")).distinct()
    table = words.select("phrase", F.array(F.concat("phrase", F.lit("-"), "phrase"), F.concat(F.lit("("), "phrase", F.lit(")"))).alias("options"))
    return lx.replace_listed(fx.tweets(spark, sf), "tweet_content", "tweet_id", table, au.P_SYNONYM, SEED).select(
        "tweet_id", "augmented")


@query
def words_unlisted(spark, sf):
    """Words that are not in a stopword table: the benchmark's words."""
    listed = wd.exploded_words(fx.table(spark, sf, "benchmark"), "text")
    return lx.count_unlisted(fx.tweets(spark, sf), "tweet_content", listed)


@query
def augment_swap(spark, sf):
    return _augment_one(spark, sf, "swap", au.P_SWAP)


@query
def augment_typo(spark, sf):
    return _augment_one(spark, sf, "typo", au.P_TYPO)


@query
def augment_table(spark, sf):
    return au.augment(fx.labelled(spark, sf), 3, SEED, BASE_TIME, mapping=QUERY_SYNONYMS)


@query
def resample_uniform(spark, sf):
    return sa.resample(fx.labelled(spark, sf), 2.0, SEED, "tweet_id").select(
        "tweet_id", F.col("copy").cast("long").alias("copy"), "entity", "sentiment")


@query
def resample_to_profile(spark, sf):
    lab = fx.labelled(spark, sf)
    n = lab.agg(F.count(F.lit(1))).scalar()
    return sa.resample_to_profile(lab, "sentiment", sa.REFERENCE_PROFILE, n, SEED, "tweet_id") \
        .select("tweet_id", F.col("copy").cast("long").alias("copy"), "sentiment")


# -------------------------------------------------------------- measures ---



@query
def mean_sentiment(spark, sf):
    m = ms.mean_sentiment(fx.tweets(spark, sf), "entity")
    return m.select("entity", "n", r6("mean_score").alias("mean_score"))


@query
def sentiment_hourly(spark, sf):
    """Average sentiment per hour over the events mapped to classes."""
    ev = wall_clock_events(spark, sf).select("ts", fx.event_class("sentiment").alias("sentiment"))
    t = ms.sentiment_over_time(ev, "ts", "1 hour")
    return t.select("w_start", "w_end", "n", r6("mean_score").alias("mean_score"))


@query
def mention_volume(spark, sf):
    return ms.mention_volume(wall_clock_events(spark, sf), "ts", "entity", "1 day")


@query
def mention_bursts(spark, sf):
    """Runs of two or more mentions of a user, none over two hours apart."""
    return ms.mention_bursts(wall_clock_events(spark, sf), "ts", "entity", BURST_GAP, 2)


@query
def hashtag_trend(spark, sf):
    """Tags of the tagged texts, over time: each text on the day its id gives."""
    t = fx.tweets_tagged(spark, sf)
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(tweet_id % 10 as int))")
    return ms.hashtag_trend(t.select("tweet_content", at.alias("ts")), "tweet_content", "ts", "1 day")


@query
def opinion_by_region(spark, sf):
    ev = fx.table(spark, sf, "events").select("user_id", fx.event_class("event_type").alias("sentiment"))
    o = ms.opinion_by_region(ev, fx.region_dimension(spark, sf), "user_id", "sentiment",
                             ["Positive", "Negative", "Neutral"])
    return o.select("r_name", "n", *[r6(c).alias(c) for c in
                                     ["share_positive", "share_negative", "share_neutral", "mean_score"]])


@query
def corpus_profile(spark, sf):
    """Profile of the de-duplicated train + validation corpus: keep-first once,
    its rows written once and read by the branches."""
    kept = dd.keep_first(corpus(spark, sf), ["tweet_id"], ["source_rank"], total=True)
    kept = materialize(kept.select("entity", "sentiment", "tweet_content"), "corpus")
    p = ag.corpus_profile(kept)
    return p.select("section", "key", r6("value").alias("value"))
