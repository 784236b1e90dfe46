"""Dictionaries as tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from pulse.operators import augment as au
from pulse.operators import lexicon as lx
from pulse.operators import words as wd
from pulse.sources import fixtures as fx


def table(spark, mapping):
    return spark.createDataFrame(list(mapping.items()), "phrase string, options array<string>")


MAPPING = {"the": ["a", "that", "this"], "of": ["for"], "tion": ["shun", "sion"]}


@pytest.mark.parametrize("p", [1.0, 0.3])
def test_equals_the_literal_map(spark, p):
    docs = fx.tweets(spark, SF001).select("tweet_id", "tweet_content")
    want = au.augment_words(docs, "tweet_content", "tweet_id", 5, 0, MAPPING, p_syn=p, steps=("syn",))
    got = lx.replace_listed(docs, "tweet_content", "tweet_id", table(spark, MAPPING), p, 5)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.where(F.col("augmented") != F.array_join(F.split("tweet_content", r"\s+"), " ")).count() > 50


def test_phrases_first_and_longest(spark):
    df = spark.createDataFrame([(1, "new york city is new york"), (1, "new york city is new york"), (2, None), (3, ""), (4, " a  b ")],
                               "id long, t string")
    m = {"new york": ["nyc"], "new york city": ["gotham"], "york": ["x"], "city is": ["y"], None: ["z"], "a": [], "b": [None, "c"]}
    got = lx.replace_listed(df, "t", "id", table(spark, m), 1.0, 7, longest=3)
    assert sorted(((r["id"], r["augmented"]) for r in got.collect()), key=str) == [
        (1, "gotham is nyc"), (1, "gotham is nyc"), (2, None), (3, ""), (4, "a c")]


def test_a_million_keys_are_no_literal(spark):
    many = spark.range(1_000_000).select(F.concat(F.lit("w"), "id").alias("phrase"), F.array(F.concat(F.lit("v"), "id")).alias("options"))
    df = spark.createDataFrame([(1, "w5 x w999999 w1000000")], "id long, t string")
    out = lx.replace_listed(df, "t", "id", many, 1.0, 7)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "w999999" not in plan and len(plan) < 40_000 and "Join" in plan
    assert out.first()["augmented"] == "v5 x v999999 w1000000"


def test_a_hot_word_is_spread(spark):
    """One word at nearly all positions goes to all salts, and comes back right."""
    df = spark.createDataFrame([(i, "the " * 50 + f"x{i}") for i in range(40)], "id long, t string")
    got = lx.replace_listed(df, "t", "id", table(spark, {"the": ["a"]}), 1.0, 1, salts=4).collect()
    assert all(r["augmented"] == "a " * 50 + f"x{r['id']}" for r in got)


def test_stopword_table_equals_the_list(spark):
    df = fx.tweets(spark, SF001)
    listed = spark.createDataFrame([(w,) for w in [*wd.STOPWORDS, None, "the"]], "word string")
    want = wd.drop_stopwords(wd.exploded_words(df, "tweet_content")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    got = lx.count_unlisted(df, "tweet_content", listed)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 0


def test_a_text_is_hashed_once_and_not_per_word(spark):
    """The key of a text stands below the step that makes its words rows."""
    df = spark.createDataFrame([(1, "the cat of the house")], "id long, t string")
    out = lx.replace_listed(df, "t", "id", table(spark, MAPPING), 1.0, 5)
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    words = next(i for i, x in enumerate(lines) if "Generate" in x and "explode" in x and "options" not in x)
    assert next(i for i, x in enumerate(lines) if "AS _row" in x) > words
    assert out.first()["augmented"].split()[::3] in ([w, x] for w in MAPPING["the"] for x in MAPPING["the"])
