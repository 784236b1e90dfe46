"""Operators on empty input: no errors, empty or zero results."""

from pulse.operators import aggregates as ag
from pulse.operators import augment as au
from pulse.operators import dedup as dd
from pulse.operators import drift as dq
from pulse.operators import measures as ms
from pulse.operators import resample as sa
from pulse.operators import words as wd
from pulse.streaming import messages as sm
from pulse.streaming.windows import minute_counts

SCHEMA = "tweet_id long, entity string, sentiment string, tweet_content string"


def test_operators_on_empty_input(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert ag.shares(e, "sentiment").count() == 0
    assert ag.top_by_count(e, "entity").count() == 0
    assert ag.column_profile(e).count() == 4
    assert wd.top_words(e, "tweet_content").count() == 0
    assert wd.top_words_by(e, "sentiment", "tweet_content", n=5, pool=10).count() == 0
    assert dd.keep_first(e, ["tweet_id"], ["entity"]).count() == 0
    assert dq.category_drift(e, e, "sentiment").count() == 0
    assert dq.integrity_report(e).first()["rows"] == 0
    assert dq.table_profiles(e, e).count() == 0
    assert au.augment(e, 2, 1, 0.0).count() == 0
    assert sa.resample(e, 2.0, 1, "tweet_id").count() == 0
    assert sa.resample_to_profile(e, "sentiment", {"Positive": 1.0}, 0, 1, "tweet_id").count() == 0
    assert ms.mean_sentiment(e).count() == 0
    msgs = spark.createDataFrame([], "value string")
    assert minute_counts(sm.accepted(sm.decode_messages(msgs))).count() == 0
