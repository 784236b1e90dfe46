"""Text expressions: the in-line cases of FIXTURES.md and a Python
re-statement of the notebook's tokenizer as an independent check."""

import re
from collections import Counter

from pyspark.sql import functions as F

from conftest import SF001
from pulse.functions import text as tx
from pulse.operators import words as wd
from pulse.sources import fixtures as fx


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr("t").alias("r")).first()["r"]


def test_clean_ascii_drops_accents_and_digits(spark):
    assert one(spark, tx.clean_text, "Love #x café 2") == "love x caf "


def test_clean_ascii_keeps_null(spark):
    assert one(spark, tx.clean_text, None) is None


def test_clean_digits_mode(spark):
    f = lambda c: tx.clean_text(c, "ascii_digits")
    assert one(spark, f, "Café 2, OK!") == "caf 2 ok"
    assert one(spark, f, None) == ""


def test_tokens_unicode_word_start(spark):
    assert one(spark, tx.tokens, "abc123def naïve über _x don't") == ["abc", "na", "über", "don", "t"]


def test_strip_markup(spark):
    assert one(spark, tx.strip_markup, "Hi @bob see http://x.y/z #Tag ok") == "hi  see   ok"


def test_hashtags_keep_case(spark):
    assert one(spark, tx.hashtags, "#Go #go_2 x#y #") == ["#Go", "#go_2", "#y"]


def test_words_split_like_python(spark):
    s = " a b\tc d  e\n"
    assert one(spark, tx.words, s) == s.split()


def py_tokenize(text):
    text = re.sub(r"http\S+|@\S+|#\S+", "", str(text).lower())
    return re.findall(r"\b[a-záéíóúñü]+", text)


def test_tokens_equal_python_on_documents(spark):
    t = fx.tweets_tagged(spark, SF001).select("tweet_id", "tweet_content")
    rows = t.select("tweet_id", "tweet_content", tx.tokens("tweet_content").alias("w")).collect()
    assert rows
    for r in rows:
        assert r["w"] == py_tokenize(r["tweet_content"]), r["tweet_id"]


def test_top_words_equal_counter(spark):
    t = fx.tweets(spark, SF001)
    texts = [r[0] for r in t.select("tweet_content").collect()]
    c = Counter(w for x in texts for w in py_tokenize(x))
    expect = sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:20]
    got = [(r["word"], r["count"]) for r in wd.top_words(t, "tweet_content", 20).collect()]
    assert got == expect


def test_words_equal_python_split_on_documents(spark):
    t = fx.tweets(spark, SF001).select("tweet_content", tx.words("tweet_content").alias("w"))
    for r in t.collect():
        assert r["w"] == r["tweet_content"].split()


def test_length_counts_code_points(spark):
    assert one(spark, lambda c: tx.text_length(c), "naïve😀") == 6
