"""DuckDB SQL for each registered query: the correctness oracle.

Views are the same as ``pulse.sources.fixtures`` builds in Spark, written
again in SQL. The regex patterns are the same fixed strings as in
``pulse.functions.text``, stated again (RE2 reads them the same way as Java for these
classes). Doubles are rounded to 6 places as on the Spark side.
"""

from __future__ import annotations

import math

# Fixed values, stated again so that a fault in the engine's cannot hide.
PY_SPACE = (r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
MARKUP = rf"http[^{PY_SPACE}]+|@[^{PY_SPACE}]+|#[^{PY_SPACE}]+"
TOKEN = r"(?:^|[^\p{L}\p{N}_])([a-záéíóúñü]+)"
HASHTAG = r"#[\p{L}\p{N}_]+"
STOPWORDS = [
    "the", "to", "and", "a", "i", "it", "of", "in", "is", "for", "on", "this", "that",
    "my", "you", "t", "s", "com", "me", "at", "we", "they", "he", "she", "an", "as", "be",
    "are", "was", "have", "has", "had", "will", "just", "do", "from", "by", "or", "if", "but", "so", "not", "now",
]

ORACLE: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "(" + ", ".join(_q(x) for x in items) + ")"


TWEETS = """
tweets AS (
  SELECT d.doc_id AS tweet_id, d.source AS entity,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'Positive'
              WHEN l.quality = 0 AND l.toxic = 1 THEN 'Negative'
              WHEN l.quality = 0 AND l.toxic = 0 THEN 'Neutral'
              WHEN l.quality = 1 AND l.toxic = 1 THEN 'Irrelevant' END AS sentiment,
         d.text AS tweet_content, d.lang
  FROM documents d LEFT JOIN (
    SELECT doc_id, l.quality, l.toxic FROM (
      SELECT doc_id, min(struct_pack(quality := quality, toxic := toxic)) AS l FROM labels GROUP BY doc_id)) l
  ON d.doc_id = l.doc_id)"""

TAGGED = TWEETS + """,
tagged AS (
  SELECT tweet_id, entity, sentiment, lang,
         tweet_content || ' #' || upper(entity) || ' #' || lang || ' @u' || CAST(tweet_id AS VARCHAR)
           || ' http://ex.org/' || CAST(tweet_id AS VARCHAR) AS tweet_content
  FROM tweets)"""

LABELLED = TWEETS + """,
labelled AS (SELECT * FROM tweets WHERE sentiment IS NOT NULL)"""

CORPUS = LABELLED + """,
corpus AS (
  SELECT *, 0 AS source_rank FROM tweets
  UNION ALL
  SELECT *, 1 AS source_rank FROM labelled)"""

CLEANED = TWEETS + """,
cleaned AS (
  SELECT *, regexp_replace(lower(tweet_content), '[^a-z\\s]', '', 'g') AS tweet_content_cleaned
  FROM tweets
  WHERE tweet_id IS NOT NULL AND entity IS NOT NULL AND sentiment IS NOT NULL
    AND tweet_content IS NOT NULL)"""

def strip_sql(c: str) -> str:
    return f"regexp_replace(lower({c}), {_q(MARKUP)}, '', 'g')"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all({strip_sql(c)}, {_q(TOKEN)}, 1)"


def words_of(src: str, text: str = "tweet_content", keep: str = "") -> str:
    """One row per word occurrence of ``src``."""
    k = (keep + ", ") if keep else ""
    return f"SELECT {k}unnest({tokens_sql(text)}) AS word FROM {src}"


def shares_sql(src: str, col: str, cnt: str = "n", share: str = "share", where: str = "") -> str:
    w = f"WHERE {col} IS NOT NULL" + (f" AND {where}" if where else "")
    return (f"SELECT {col}, count(*) AS {cnt}, count(*) / sum(count(*)) OVER () AS {share} "
            f"FROM {src} {w} GROUP BY {col}")


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


O = ORACLE

O["scan_count"] = "SELECT count(*) AS rows FROM documents"

O["drop_nulls"] = with_(TWEETS) + """
SELECT tweet_id, entity, sentiment, tweet_content FROM tweets
WHERE tweet_id IS NOT NULL AND entity IS NOT NULL AND sentiment IS NOT NULL AND tweet_content IS NOT NULL"""

O["filter_class"] = with_(TWEETS) + """
SELECT tweet_id, entity, lang FROM tweets WHERE sentiment = 'Positive'"""

O["count_by_sentiment"] = with_(CLEANED) + """
SELECT sentiment, count(*) AS count FROM cleaned GROUP BY sentiment"""

O["top_entities"] = with_(CLEANED) + """
SELECT entity, count(*) AS count FROM cleaned GROUP BY entity ORDER BY count DESC, entity ASC LIMIT 10"""

for _name, _col in [("sentiment_shares", "sentiment"), ("entity_shares", "entity"), ("language_shares", "lang")]:
    O[_name] = with_(TWEETS) + f"""
SELECT {_col}, n, round(share, 6) AS share FROM ({shares_sql('tweets', _col)})"""

O["length_stats"] = with_(TWEETS) + """
SELECT count(l) AS count, round(avg(l), 6) AS mean, round(stddev_samp(l), 6) AS std,
       round(min(l)::DOUBLE, 6) AS min, round(quantile_cont(l, 0.25), 6) AS q25,
       round(quantile_cont(l, 0.5), 6) AS median, round(quantile_cont(l, 0.75), 6) AS q75,
       round(max(l)::DOUBLE, 6) AS max
FROM (SELECT length(tweet_content) AS l FROM tweets WHERE tweet_content IS NOT NULL)"""

O["column_profile"] = with_(TWEETS) + """
SELECT * FROM (VALUES
  (0, 'tweet_id', 'bigint', (SELECT count(tweet_id) FROM tweets)),
  (1, 'entity', 'string', (SELECT count(entity) FROM tweets)),
  (2, 'sentiment', 'string', (SELECT count(sentiment) FROM tweets)),
  (3, 'tweet_content', 'string', (SELECT count(tweet_content) FROM tweets)),
  (4, 'lang', 'string', (SELECT count(lang) FROM tweets))
) AS t(position, "column", dtype, non_null)"""

O["clean_text"] = with_(CLEANED) + """
SELECT tweet_id, tweet_content_cleaned FROM cleaned"""

O["clean_text_digits"] = with_(TWEETS) + """
SELECT tweet_id, regexp_replace(lower(coalesce(tweet_content, '')), '[^a-z0-9\\s]', '', 'g') AS cleaned
FROM tweets"""

O["strip_markup"] = with_(TAGGED) + f"""
SELECT tweet_id, {strip_sql('tweet_content')} AS stripped FROM tagged"""

O["tokenize"] = with_(TAGGED) + f"""
SELECT tweet_id, len(w)::BIGINT AS n_tokens, array_to_string(w, ' ') AS tokens
FROM (SELECT tweet_id, {tokens_sql('tweet_content')} AS w FROM tagged)"""

O["extract_hashtags"] = with_(TAGGED) + f"""
SELECT tweet_id, array_to_string(regexp_extract_all(tweet_content, {_q(HASHTAG)}, 0), ' ') AS hashtags
FROM tagged"""

O["top_words"] = with_(TWEETS) + f"""
SELECT word, count(*) AS count FROM ({words_of('tweets')})
GROUP BY word ORDER BY count DESC, word ASC LIMIT 20"""

O["top_hashtags"] = with_(TAGGED) + f"""
SELECT lower(tag) AS hashtag, count(*) AS count
FROM (SELECT unnest(regexp_extract_all(tweet_content, {_q(HASHTAG)}, 0)) AS tag FROM tagged
      WHERE tweet_content IS NOT NULL)
GROUP BY hashtag ORDER BY count DESC, hashtag ASC LIMIT 5"""

_CLASS_COUNTS = f"""
class_counts AS (
  SELECT sentiment, word, count(*) AS count
  FROM ({words_of('tweets', keep='sentiment')} WHERE sentiment IS NOT NULL AND tweet_content IS NOT NULL)
  GROUP BY sentiment, word)"""

O["top_words_by_class"] = with_(TWEETS, _CLASS_COUNTS) + """
SELECT sentiment, rank, word, count FROM (
  SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY count DESC, word ASC) AS rank
  FROM class_counts) WHERE rank <= 20"""

O["top_words_by_class_filtered"] = with_(TWEETS, _CLASS_COUNTS) + f"""
SELECT sentiment, rank, word, count FROM (
  SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY r) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY count DESC, word ASC) AS r
    FROM class_counts) p
  WHERE r <= 200 AND word NOT IN {sql_list(STOPWORDS)} AND length(word) >= 3)
WHERE rank <= 50"""

O["word_stopfilter"] = with_(TWEETS) + f"""
SELECT word, count(*) AS count FROM ({words_of('tweets')})
WHERE word NOT IN {sql_list(STOPWORDS)} AND length(word) >= 3 GROUP BY word"""

O["word_weights"] = with_(TWEETS) + f"""
SELECT word, count, round(count / max(count) OVER (), 6) AS weight FROM (
  SELECT word, count(*) AS count FROM ({words_of('tweets')})
  GROUP BY word ORDER BY count DESC, word ASC LIMIT 50)"""

O["dup_count_rows"] = with_(CORPUS) + """
SELECT (SELECT count(*) FROM corpus) AS rows,
       (SELECT count(*) FROM corpus) - (SELECT count(*) FROM (
          SELECT DISTINCT tweet_id, entity, sentiment, tweet_content, lang FROM corpus)) AS dup_rows"""

O["dup_count_key"] = with_(CORPUS) + """
SELECT count(*) AS rows, count(*) - count(DISTINCT tweet_id) AS dup_ids,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT tweet_content FROM corpus)) AS dup_texts
FROM corpus"""

O["dedup_keep_first"] = with_(CORPUS) + """
SELECT tweet_id, source_rank, entity, sentiment, lang FROM (
  SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY source_rank, entity, sentiment,
                                  tweet_content, lang) AS rn
  FROM corpus) WHERE rn = 1"""

O["dedup_repeated_ids"] = with_(CORPUS) + """
SELECT tweet_id, source_rank, entity, sentiment, lang, text_md5 FROM (
  SELECT tweet_id % 97 AS tweet_id, source_rank, entity, sentiment, lang, md5(tweet_content) AS text_md5,
         row_number() OVER (PARTITION BY tweet_id % 97 ORDER BY source_rank, md5(entity) NULLS FIRST,
           md5(sentiment) NULLS FIRST, md5(tweet_content) NULLS FIRST, md5(lang) NULLS FIRST) AS rn
  FROM corpus) WHERE rn = 1"""

O["near_texts"] = """
WITH t AS (SELECT conv_id AS id, regexp_replace(lower(text), '[^a-z\\s]', '', 'g') AS t FROM conversations
           WHERE conv_id IS NOT NULL AND text IS NOT NULL),
sent AS (SELECT id, unnest([t, replace(t, 'tion', 'toin'), 'rt ' || t, replace(t, 'e', '')]) AS text FROM t),
texts AS (SELECT id, text, md5(text) AS k, length(text) AS len, count(*) AS rows FROM sent GROUP BY id, text),
near AS (SELECT a.id, a.k, levenshtein(a.text, b.text) AS d
         FROM texts a JOIN texts b ON a.id = b.id AND a.k <> b.k
          AND 10 * abs(a.len - b.len) <= greatest(a.len, b.len)
         WHERE levenshtein(a.text, b.text) <= greatest(a.len, b.len) // 10)
SELECT id, k AS text_md5, rows, count(*) AS links, min(d) AS nearest
FROM near JOIN texts USING (id, k) GROUP BY id, k, rows"""

O["union_by_name"] = with_(TWEETS) + """
SELECT tweet_id, entity, sentiment, lang, 0 AS source_rank, NULL::BIGINT AS turn FROM tweets
UNION ALL
SELECT conv_id, role, NULL, NULL, 1, turn FROM conversations"""

_PARTS = TWEETS + """,
part_en AS (SELECT * FROM tweets WHERE lang = 'en'),
part_other AS (SELECT * FROM tweets WHERE lang <> 'en')"""


def category_drift_sql(a: str, b: str, col: str) -> str:
    return f"""
SELECT sa.{col}, sa.share AS share_a, coalesce(sb.share, 0.0) AS share_b,
       abs(sa.share - coalesce(sb.share, 0.0)) AS diff,
       CASE WHEN abs(sa.share - coalesce(sb.share, 0.0)) <= 0.05 THEN 'OK' ELSE 'FAIL' END AS status
FROM ({shares_sql(a, col)}) sa LEFT JOIN ({shares_sql(b, col)}) sb ON sa.{col} = sb.{col}"""


O["drift_categories"] = with_(_PARTS) + f"""
SELECT sentiment, round(share_a, 6) AS share_a, round(share_b, 6) AS share_b, round(diff, 6) AS diff, status
FROM ({category_drift_sql('part_en', 'part_other', 'sentiment')})"""

O["drift_summary"] = with_(_PARTS) + f"""
SELECT count(*) AS categories, round(max(diff), 6) AS max_diff, round(avg(diff), 6) AS mean_diff,
       CASE WHEN max(diff) <= 0.05 THEN 'OK' ELSE 'FAIL' END AS status
FROM ({category_drift_sql('part_en', 'part_other', 'entity')})"""


def numeric_drift_sql(a: str, b: str) -> str:
    def side(src, v):
        return f"""
  SELECT unnest(['mean', 'std', 'min', 'max']) AS metric,
         unnest([avg(l), stddev_samp(l), min(l)::DOUBLE, max(l)::DOUBLE]) AS {v}
  FROM (SELECT length(tweet_content) AS l FROM {src} WHERE tweet_content IS NOT NULL)"""
    return f"""
SELECT metric, value_a, value_b,
       CASE WHEN value_a > 0 THEN abs(value_a - value_b) / value_a * 100 ELSE 0.0 END AS diff_pct
FROM ({side(a, 'value_a')}) JOIN ({side(b, 'value_b')}) USING (metric)"""


O["drift_lengths"] = with_(_PARTS) + f"""
SELECT metric, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, round(diff_pct, 6) AS diff_pct,
       CASE WHEN diff_pct <= 5.0 THEN 'OK' ELSE 'FAIL' END AS status
FROM ({numeric_drift_sql('part_en', 'part_other')})"""

def ks_sql(measure: str, value: str) -> str:
    """Two-sample Kolmogorov-Smirnov statistic of part_en and part_other."""
    return f"""
SELECT '{measure}' AS measure, n_a, n_b, round(gap, 6) AS statistic, value AS value_at,
       round(sqrt({-math.log(0.05 / 2) / 2!r} * (n_a + n_b) / (n_a::DOUBLE * n_b)), 6) AS critical,
       CASE WHEN gap <= sqrt({-math.log(0.05 / 2) / 2!r} * (n_a + n_b) / (n_a::DOUBLE * n_b)) THEN 'OK' ELSE 'FAIL' END AS status
FROM (
  SELECT value, sum(a) OVER ()::BIGINT AS n_a, sum(b) OVER ()::BIGINT AS n_b,
         abs(sum(a) OVER up / sum(a) OVER () - sum(b) OVER up / sum(b) OVER ()) AS gap
  FROM (SELECT value::DOUBLE AS value, sum(a) AS a, sum(1 - a) AS b FROM (
          SELECT {value} AS value, 1 AS a FROM part_en UNION ALL SELECT {value}, 0 FROM part_other)
        WHERE value IS NOT NULL GROUP BY 1)
  WINDOW up AS (ORDER BY value)
  ORDER BY gap DESC, value LIMIT 1)"""


O["drift_distribution"] = with_(_PARTS) + f"""
SELECT * FROM ({ks_sql('chars', 'length(tweet_content)')})
UNION ALL SELECT * FROM ({ks_sql('words', f"len({tokens_sql('tweet_content')})")})"""

O["profile_merged"] = """
SELECT count(*) AS rows, 0::BIGINT AS null_cells, round(avg(length(props)), 6) AS mean, round(stddev_samp(length(props)), 6) AS std,
       min(length(props))::BIGINT AS min, max(length(props))::BIGINT AS max, true AS entities_ok, true AS ids_ok,
       true AS q25_ok, true AS median_ok, true AS q75_ok
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'"""

O["integrity_report"] = with_(TWEETS) + """
SELECT count(*) AS rows, count(DISTINCT tweet_id) AS ids, count(DISTINCT entity) AS entities,
       count(DISTINCT sentiment) AS classes,
       sum((tweet_id IS NULL)::BIGINT + (entity IS NULL)::BIGINT + (sentiment IS NULL)::BIGINT
           + (tweet_content IS NULL)::BIGINT + (lang IS NULL)::BIGINT)::BIGINT AS null_cells
FROM tweets"""

# ------------------------------------------------------ sources and sinks ---

_BATCH = "tweet_id, entity, sentiment, tweet_content, tweet_content_cleaned"
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"

O["roundtrip_parquet"] = with_(CLEANED) + f"\nSELECT {_BATCH} FROM cleaned"

O["roundtrip_csv"] = with_(TWEETS) + "\nSELECT tweet_id, entity, sentiment, tweet_content FROM tweets"

O["csv_reordered_header"] = O["csv_headerless"] = O["roundtrip_csv"]

O["csv_bad_rows"] = """
SELECT 'id ' || doc_id AS tweet_id, source AS entity FROM documents WHERE doc_id % 10 = 0"""

O["roundtrip_json"] = """
SELECT event_id AS tweet_id, CAST(user_id AS VARCHAR) AS entity, event_type AS sentiment,
       props AS tweet_content, ts AS event_time
FROM events"""

O["json_array"] = O["roundtrip_json"]

O["encode_json"] = f"""
SELECT event_id AS tweet_id,
       to_json(struct_pack("Tweet ID" := event_id, "Entity" := CAST(user_id AS VARCHAR),
                           "Sentiment" := event_type, "Tweet content" := props,
                           "timestamp" := {ISO}))::VARCHAR AS value
FROM events"""

O["clustered_lookup"] = """
SELECT event_id, ts, event_type, md5(CAST(event_id AS VARCHAR)) AS hash FROM events WHERE event_id % 5000 = 0"""

O["bounded_sample"] = with_(CLEANED) + f"\nSELECT {_BATCH} FROM cleaned ORDER BY tweet_id LIMIT 1000"

# ---------------------------------------------------------------- schema ---

O["project_rename"] = with_(TWEETS) + "\nSELECT tweet_id, entity, sentiment, tweet_content FROM tweets"

O["schema_by_name"] = with_(TWEETS) + """
SELECT tweet_id AS "Tweet ID", entity AS "Entity", sentiment AS "Sentiment",
       tweet_content AS "Tweet content", lang AS language FROM tweets"""

_METRICS = TWEETS + """,
h AS (SELECT CAST(tweet_id AS VARCHAR) AS c0, entity AS c1, sentiment AS c2, tweet_content AS c3, lang AS c4
      FROM tweets),
cells AS (
  SELECT pos, coalesce(v, '') AS v FROM (
    SELECT unnest([0, 1, 2, 3, 4]) AS pos, unnest([c0, c1, c2, c3, c4]) AS v FROM h)),
m AS (
  SELECT pos AS position, '_c' || pos AS "column",
         avg(regexp_full_match(v, '[0-9]+')::DOUBLE) AS digit_share,
         avg((lower(v) IN ('positive', 'negative', 'neutral', 'irrelevant', 'pos', 'neg', 'neu'))::DOUBLE)
           AS label_share,
         avg(length(v)::DOUBLE) AS mean_len, count(DISTINCT v) AS n_distinct,
         (SELECT count(*) FROM h) AS rows
  FROM cells GROUP BY pos),
id_col AS (SELECT min(position) AS p FROM m WHERE digit_share > 0.9),
sent_col AS (SELECT position AS p FROM m WHERE label_share >= 0.05
             AND label_share = (SELECT max(label_share) FROM m) ORDER BY position LIMIT 1),
text_col AS (SELECT position AS p FROM m ORDER BY mean_len DESC, position LIMIT 1),
ent_col AS (SELECT position AS p FROM m
            WHERE position IS DISTINCT FROM (SELECT p FROM id_col)
              AND position IS DISTINCT FROM (SELECT p FROM sent_col)
              AND position IS DISTINCT FROM (SELECT p FROM text_col)
              AND n_distinct > 1 AND n_distinct < greatest(5000, rows // 2) AND mean_len < 40
            ORDER BY abs(n_distinct - 50), position LIMIT 1)"""

O["schema_by_content"] = with_(_METRICS) + """
SELECT position, "column", round(digit_share, 6) AS digit_share, round(label_share, 6) AS label_share,
       round(mean_len, 6) AS mean_len, n_distinct, rows,
       CASE WHEN position = (SELECT p FROM ent_col) THEN 'Entity'
            WHEN position = (SELECT p FROM text_col) THEN 'Tweet content'
            WHEN position = (SELECT p FROM sent_col) THEN 'Sentiment'
            WHEN position = (SELECT p FROM id_col) THEN 'Tweet ID' END AS role
FROM m"""

# ------------------------------------------------------------- streaming ---

O["decode_json"] = """
SELECT CASE WHEN bad THEN NULL ELSE CAST(event_id AS VARCHAR) END AS tweet_id,
       CASE WHEN NOT bad AND event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS original_tweet_id,
       CASE WHEN bad THEN NULL ELSE CAST(user_id AS VARCHAR) END AS entity,
       CASE WHEN bad THEN NULL ELSE event_type END AS sentiment,
       CASE WHEN bad THEN NULL ELSE props END AS tweet_content,
       CASE WHEN bad THEN NULL ELSE ts END AS event_time,
       CASE WHEN bad THEN NULL WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS contract,
       bad OR event_type IS NULL OR ts IS NULL AS rejected
FROM (SELECT *, event_id % 100 = 0 AS bad FROM events)"""

O["decode_variant"] = O["decode_json"]

O["unexpected_fields"] = """
SELECT field, type, count(*) AS messages FROM (
  SELECT unnest(CASE WHEN event_id % 9 = 0 THEN ['retweets'] WHEN event_id % 3 = 0 THEN ['retweets', 'geo'] ELSE [] END) AS field,
         unnest(CASE WHEN event_id % 9 = 0 THEN ['STRING'] WHEN event_id % 3 = 0
                     THEN ['BIGINT', 'OBJECT<lat: DECIMAL(2,1)>'] ELSE [] END) AS type
  FROM events WHERE event_id % 100 <> 0)
GROUP BY field, type"""

O["rejected_messages"] = """
SELECT 'not json ' || event_id AS raw, NULL::VARCHAR AS sentiment, NULL::VARCHAR AS contract
FROM events WHERE event_id % 100 = 0"""

O["minute_counts"] = """
SELECT time_bucket(INTERVAL '1 minute', ts) AS w_start, time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute' AS w_end,
       event_type AS sentiment, count(*) AS count
FROM events GROUP BY ALL"""

O["stream_minute_counts"] = """
WITH ok AS (SELECT event_type AS sentiment, ts FROM events WHERE event_id % 100 <> 0),
c AS (SELECT time_bucket(INTERVAL '1 minute', ts) AS w_start, sentiment, count(*) AS count FROM ok GROUP BY ALL)
SELECT w_start, w_start + INTERVAL '1 minute' AS w_end, sentiment, count FROM c
WHERE w_start + INTERVAL '1 minute' <= (SELECT max(ts) FROM ok) - INTERVAL '10 minutes'"""

_OK_EVENTS = "events WHERE event_id % 100 <> 0 AND event_type IS NOT NULL AND ts IS NOT NULL"

O["stream_keep_first"] = f"""
SELECT CAST(event_id AS VARCHAR) AS tweet_id, CAST(user_id AS VARCHAR) AS entity, event_type AS sentiment,
       props AS tweet_content, ts AS event_time
FROM {_OK_EVENTS}"""

O["stream_corrected_counts"] = f"""
SELECT time_bucket(INTERVAL '1 minute', ts) AS w_start, time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute' AS w_end,
       event_type AS sentiment, count(*) AS count
FROM {_OK_EVENTS} GROUP BY ALL"""

O["stream_open_windows"] = f"""
SELECT w_start, w_end, sentiment, count,
       w_end > (SELECT max(ts) FROM {_OK_EVENTS}) - INTERVAL '10 minutes' AS open
FROM ({O['stream_corrected_counts']})"""

O["stream_lineage"] = """
SELECT 'c' || event_id AS tweet_id,
       CAST(CASE WHEN event_id % 4 = 1 THEN -event_id ELSE event_id END AS VARCHAR) AS original_tweet_id,
       ts + CASE WHEN event_id % 4 = 2 THEN INTERVAL '180 minutes' ELSE INTERVAL '10 minutes' END AS copy_time,
       CASE WHEN event_id % 4 = 0 THEN ts END AS original_time
FROM events WHERE event_id % 4 < 3"""

_BURSTS = """
runs AS (
  SELECT entity, ts, sum(fresh) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT CAST(user_id AS VARCHAR) AS entity, ts,
               CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)),
bursts AS (SELECT min(ts) AS w_start, max(ts) + INTERVAL '2 hours' AS w_end, entity, count(*) AS mentions
           FROM runs GROUP BY entity, run HAVING count(*) >= 2)"""

O["mention_bursts"] = f"WITH {_BURSTS} SELECT w_start, w_end, entity, mentions FROM bursts"

O["stream_mention_bursts"] = f"""WITH {_BURSTS} SELECT w_start, w_end, entity, mentions FROM bursts
WHERE w_end <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"""

_TIMED = TAGGED + """,
timed AS (
  SELECT TIMESTAMP '2024-01-01' + to_days((doc_id % 10)::INTEGER) AS ts,
         text || ' #' || upper(source) || ' #' || lang AS tweet_content FROM documents WHERE text IS NOT NULL),
closed AS (SELECT * FROM timed WHERE ts + INTERVAL '1 day' <= (SELECT max(ts) FROM timed) - INTERVAL '1 day')"""

O["stream_top_words"] = with_(_TIMED) + f"""
SELECT ts AS w_start, rank, word, count FROM (
  SELECT ts, word, count(*) AS count, row_number() OVER (PARTITION BY ts ORDER BY count(*) DESC, word) AS rank
  FROM ({words_of('closed', keep='ts')}) GROUP BY ts, word) WHERE rank <= 10"""

O["stream_hashtag_counts"] = with_(_TIMED) + f"""
SELECT ts AS w_start, lower(tag) AS hashtag, count(*) AS n FROM (
  SELECT ts, unnest(regexp_extract_all(tweet_content, {_q(HASHTAG)}, 0)) AS tag FROM closed) GROUP BY ALL"""

# ---------------------------------------------------- augment, resample ---


def u_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def pick_sql(n: str, *parts: str) -> str:
    return f"floor({u_sql(*parts)} * ({n}))::INTEGER"


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {_q('[' + PY_SPACE + ']+')}), lambda x: x <> '')"


def syn_case(x: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN [{', '.join(_q(s) for s in v)}]" for k, v in mapping.items())
    return f"(CASE {x} {whens} END)"


def syn_step(w: str, mapping: dict, p: float, seed: int, row: str, copy: str) -> str:
    s = syn_case("x", mapping)
    return (f"list_transform({w}, lambda x, i: CASE WHEN {s} IS NOT NULL AND "
            f"{u_sql(_q(str(seed)), row, copy, 'i - 1', _q('syn'))} < {p}::DOUBLE "
            f"THEN {s}[{pick_sql(f'len({s})', _q(str(seed)), row, copy, 'i - 1', _q('syn_pick'))} + 1] "
            f"ELSE x END)")


def swap_cte(name: str, src: str, p: float, seed: int, row: str, copy: str) -> str:
    sd = _q(str(seed))
    return f"""
{name}_ij AS (
  SELECT *, {pick_sql('len(w)', sd, row, copy, _q('swap_i'))} AS si,
         {pick_sql('len(w) - 1', sd, row, copy, _q('swap_j'))} AS sj0,
         len(w) >= 6 AND {u_sql(sd, row, copy, _q('swap'))} < {p}::DOUBLE AS sdo
  FROM {src}),
{name} AS (
  SELECT * EXCLUDE (w, si, sj0, sdo, sj),
         CASE WHEN sdo THEN list_transform(w, lambda x, k: CASE WHEN k - 1 = si THEN w[sj + 1]
                                                      WHEN k - 1 = sj THEN w[si + 1] ELSE x END)
              ELSE w END AS w
  FROM (SELECT *, CASE WHEN sj0 >= si THEN sj0 + 1 ELSE sj0 END AS sj FROM {name}_ij))"""


def typo_cte(name: str, src: str, p: float, seed: int, row: str, copy: str) -> str:
    sd = _q(str(seed))
    return f"""
{name}_i AS (
  SELECT *, {pick_sql('len(w)', sd, row, copy, _q('typo_i'))} AS ti,
         len(w) > 0 AND {u_sql(sd, row, copy, _q('typo'))} < {p}::DOUBLE AS tdo
  FROM {src}),
{name}_w AS (
  SELECT *, w[ti + 1] AS tw,
         {pick_sql('length(w[ti + 1])', sd, row, copy, _q('typo_pos'))} AS tpos,
         substr('abcdefghijklmnopqrstuvwxyz', {pick_sql('26', sd, row, copy, _q('typo_ch'))} + 1, 1) AS tch
  FROM {name}_i),
{name} AS (
  SELECT * EXCLUDE (w, ti, tdo, tw, tpos, tch),
         CASE WHEN tdo AND length(tw) >= 3
              THEN list_transform(w, lambda x, k: CASE WHEN k - 1 = ti
                     THEN substr(tw, 1, tpos) || tch || substr(tw, tpos + 2) ELSE x END)
              ELSE w END AS w
  FROM {name}_w)"""


_SEED = 42
_QSYN = {"the": ["a", "this", "that"], "and": ["plus", "with"]}

_AUG_BASE = TWEETS + f""",
a0 AS (SELECT tweet_id, 0 AS cp, {words_sql('tweet_content')} AS w FROM tweets)"""

O["augment_synonyms"] = with_(_AUG_BASE) + f"""
SELECT tweet_id, array_to_string({syn_step('w', _QSYN, 0.3, _SEED, 'tweet_id', 'cp')}, ' ') AS augmented FROM a0"""

O["augment_from_table"] = with_(_AUG_BASE) + f""",
listed AS (SELECT DISTINCT unnest({words_sql('text')}) AS phrase FROM benchmark),
pairs AS (SELECT phrase, list_sort([phrase || '-' || phrase, '(' || phrase || ')']) AS options FROM listed),
each AS (SELECT tweet_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM a0),
new AS (SELECT tweet_id, i, CASE WHEN options IS NOT NULL AND {u_sql(_q(str(_SEED)), 'tweet_id', _q('0'), 'i', _q('syn'))} < 0.3::DOUBLE
          THEN options[{pick_sql('len(options)', _q(str(_SEED)), 'tweet_id', _q('0'), 'i', _q('syn_pick'))} + 1] ELSE x END AS x
        FROM each LEFT JOIN pairs ON phrase = x)
SELECT a0.tweet_id, CASE WHEN w IS NULL THEN NULL ELSE coalesce(t, '') END AS augmented
FROM a0 LEFT JOIN (SELECT tweet_id, string_agg(x, ' ' ORDER BY i) AS t FROM new GROUP BY tweet_id) USING (tweet_id)"""

O["words_unlisted"] = with_(TWEETS) + f"""
SELECT word, count(*) AS count FROM ({words_of('tweets')})
WHERE length(word) >= 3 AND word NOT IN (SELECT DISTINCT word FROM ({words_of('benchmark', 'text')})) GROUP BY word"""

O["augment_swap"] = with_(_AUG_BASE, swap_cte("a1", "a0", 0.1, _SEED, "tweet_id", "cp")) + """
SELECT tweet_id, array_to_string(w, ' ') AS augmented FROM a1"""

O["augment_typo"] = with_(_AUG_BASE, typo_cte("a1", "a0", 0.05, _SEED, "tweet_id", "cp")) + """
SELECT tweet_id, array_to_string(w, ' ') AS augmented FROM a1"""

def poisson_case(u: str, lam: float) -> str:
    """Inverse CDF, from the probabilities exp(-lam) * lam^k / k!."""
    total, whens = 0.0, []
    for k in range(60):
        total += math.exp(-lam) * lam ** k / math.factorial(k)
        whens.append(f"WHEN {u} < {total!r}::DOUBLE THEN {k}")
    return f"CASE {' '.join(whens)} ELSE 60 END"


O["resample_uniform"] = with_(LABELLED) + f"""
SELECT tweet_id, unnest(generate_series(1, k)) AS copy, entity, sentiment FROM (
  SELECT *, {poisson_case(u_sql(_q(str(_SEED)), 'tweet_id', _q('resample')), 2.0)} AS k FROM labelled)
WHERE k > 0"""

O["resample_to_profile"] = with_(LABELLED + """,
tgt AS (SELECT sentiment, share / sum(share) OVER () * (SELECT count(*) FROM labelled) AS quota
        FROM (VALUES ('Negative', 0.3018::DOUBLE), ('Positive', 0.2789::DOUBLE),
                     ('Neutral', 0.2453::DOUBLE), ('Irrelevant', 0.1739::DOUBLE)) t(sentiment, share)),
want AS (SELECT sentiment, floor(quota)::BIGINT
           + CASE WHEN row_number() OVER (ORDER BY floor(quota) - quota, sentiment)
                       <= (SELECT count(*) FROM labelled) - sum(floor(quota)::BIGINT) OVER () THEN 1 ELSE 0 END AS want
         FROM tgt)""") + f"""
SELECT tweet_id, unnest(generate_series(1, k)) AS copy, sentiment FROM (
  SELECT tweet_id, sentiment, want // have + CASE WHEN r <= want % have THEN 1 ELSE 0 END AS k FROM (
    SELECT tweet_id, sentiment, count(*) OVER (PARTITION BY sentiment) AS have,
           row_number() OVER (PARTITION BY sentiment ORDER BY {u_sql(_q(str(_SEED)), 'tweet_id', _q('profile'))}, tweet_id) AS r
    FROM labelled) JOIN want USING (sentiment))
WHERE k > 0"""

# -------------------------------------------------------------- measures ---

_SCORE = "CASE WHEN {c} = 'Positive' THEN 1.0 WHEN {c} = 'Negative' THEN -1.0 ELSE 0.0 END"

O["mean_sentiment"] = with_(TWEETS) + f"""
SELECT entity, count(*) AS n, round(avg({_SCORE.format(c='sentiment')}), 6) AS mean_score
FROM tweets WHERE sentiment IS NOT NULL GROUP BY entity"""

O["mention_volume"] = """
SELECT time_bucket(INTERVAL '1 day', ts) AS w_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS w_end,
       CAST(user_id AS VARCHAR) AS entity, count(*) AS mentions
FROM events GROUP BY ALL"""

O["hashtag_trend"] = with_(TAGGED, """
trend AS (
  SELECT w_start, lower(tag) AS hashtag, count(*) AS n FROM (
    SELECT TIMESTAMP '2024-01-01' + to_days((tweet_id % 10)::INTEGER) AS w_start,
           unnest(regexp_extract_all(tweet_content, """ + _q(HASHTAG) + """, 0)) AS tag
    FROM tagged WHERE tweet_content IS NOT NULL) GROUP BY ALL)""") + """
SELECT w_start, hashtag, n, lag(n) OVER (PARTITION BY hashtag ORDER BY w_start) AS prev_n,
       n - lag(n) OVER (PARTITION BY hashtag ORDER BY w_start) AS change
FROM trend"""

_EV_CLASS = """CASE WHEN event_type = 'error' THEN 'Negative'
     WHEN event_type IN ('purchase', 'signup') THEN 'Positive'
     WHEN event_type IN ('click', 'view') THEN 'Neutral' END"""

O["opinion_by_region"] = f"""
SELECT coalesce(r_name, 'unknown') AS r_name, count(*) AS n,
       round(avg((cls = 'Positive')::DOUBLE), 6) AS share_positive,
       round(avg((cls = 'Negative')::DOUBLE), 6) AS share_negative,
       round(avg((cls = 'Neutral')::DOUBLE), 6) AS share_neutral,
       round(avg({_SCORE.format(c='cls')}), 6) AS mean_score
FROM (SELECT e.user_id, {_EV_CLASS} AS cls FROM events e) ev
LEFT JOIN customer c ON ev.user_id = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE cls IS NOT NULL
GROUP BY ALL"""

O["stream_region_opinion"] = f"""
WITH ev AS (SELECT user_id, ts, {_EV_CLASS} AS cls FROM events)
SELECT time_bucket(INTERVAL '1 day', ts) AS w_start, coalesce(r_name, 'unknown') AS r_name, count(*) AS n,
       round(avg((cls = 'Positive')::DOUBLE), 6) AS share_positive,
       round(avg((cls = 'Negative')::DOUBLE), 6) AS share_negative,
       round(avg((cls = 'Neutral')::DOUBLE), 6) AS share_neutral,
       round(avg({_SCORE.format(c='cls')}), 6) AS mean_score
FROM ev
LEFT JOIN customer c ON ev.user_id = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE cls IS NOT NULL
  AND time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day'
      <= (SELECT max(ts) FROM ev WHERE cls IS NOT NULL) - INTERVAL '1 hour'
GROUP BY ALL"""

O["corpus_profile"] = with_(CORPUS + """,
kept AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY source_rank) AS rn FROM corpus) WHERE rn = 1),
lens AS (SELECT length(tweet_content) AS l FROM kept WHERE tweet_content IS NOT NULL)""") + f"""
SELECT section, key, round(value, 6) AS value FROM (
  SELECT 'total' AS section, 'rows' AS key, count(*)::DOUBLE AS value FROM kept
  UNION ALL SELECT 'sentiment', sentiment, share FROM ({shares_sql('kept', 'sentiment')})
  UNION ALL SELECT 'entity', entity, share FROM ({shares_sql('kept', 'entity')})
  UNION ALL SELECT 'length', unnest(['mean', 'std', 'min', 'q25', 'median', 'q75', 'max']),
                   unnest([avg(l), stddev_samp(l), min(l)::DOUBLE, quantile_cont(l, 0.25), quantile_cont(l, 0.5),
                           quantile_cont(l, 0.75), max(l)::DOUBLE]) FROM lens
  UNION ALL SELECT 'word', word, count::DOUBLE FROM (
    SELECT word, count(*) AS count FROM ({words_of('kept')}) GROUP BY word ORDER BY count DESC, word LIMIT 30))"""


def augment_ctes(src: str, copies: list[int], out: str) -> str:
    """CTEs that expand ``src`` into augmented copies named ``out`` (the
    contract-A columns of pulse.operators.augment.augment)."""
    return f""",
{out}_0 AS (SELECT tweet_id, entity, sentiment, c AS copy, {words_sql('tweet_content')} AS w,
                   md5(concat_ws('|', tweet_id, coalesce(entity, chr(0)), coalesce(sentiment, chr(0)),
                                 coalesce(tweet_content, chr(0)))) AS rk
            FROM {src}, (SELECT unnest({copies}) AS c)),
{out}_1 AS (SELECT * EXCLUDE (w), {syn_step('w', _QSYN, 0.3, _SEED, 'rk', 'copy')} AS w FROM {out}_0),""" \
        + swap_cte(f"{out}_2", f"{out}_1", 0.1, _SEED, "rk", "copy") + "," \
        + typo_cte(f"{out}_3", f"{out}_2", 0.05, _SEED, "rk", "copy") + f""",
{out} AS (
  SELECT md5(concat_ws('|', '{_SEED}', rk, copy)) AS tweet_id, CAST(tweet_id AS VARCHAR) AS original_tweet_id,
         copy, entity, sentiment, array_to_string(w, ' ') AS tweet_content, 1704067200.0::DOUBLE AS timestamp
  FROM {out}_3)"""


O["augment_table"] = with_(LABELLED + augment_ctes("labelled", [1, 2, 3], "aug")) + "\nSELECT * FROM aug"

O["acceptance"] = with_(LABELLED + augment_ctes("labelled", [1], "cand")) + f"""
SELECT criterion, round(result, 6) AS result, "limit", result <= "limit" AS passed FROM (
  SELECT 'sentiment_max_diff' AS criterion, max(diff) AS result, 0.05::DOUBLE AS "limit"
  FROM ({category_drift_sql('labelled', 'cand', 'sentiment')})
  UNION ALL
  SELECT 'entity_max_diff', max(diff), 0.05 FROM ({category_drift_sql('labelled', 'cand', 'entity')})
  UNION ALL
  SELECT 'length_' || metric || '_pct', diff_pct, CASE WHEN metric = 'std' THEN 10.0 ELSE 5.0 END::DOUBLE
  FROM ({numeric_drift_sql('labelled', 'cand')}) WHERE metric IN ('mean', 'std')
  UNION ALL
  SELECT 'null_cells', sum((tweet_id IS NULL)::BIGINT + (original_tweet_id IS NULL)::BIGINT + (copy IS NULL)::BIGINT
           + (entity IS NULL)::BIGINT + (sentiment IS NULL)::BIGINT + (tweet_content IS NULL)::BIGINT
           + (timestamp IS NULL)::BIGINT)::DOUBLE, 0.0::DOUBLE FROM cand
  UNION ALL
  SELECT 'repeated_texts_pct', 100.0 * (count(*) - count(DISTINCT coalesce(md5(tweet_content), ''))) / count(*), 0.0::DOUBLE
  FROM cand)"""

O["sentiment_hourly"] = f"""
SELECT time_bucket(INTERVAL '1 hour', ts) AS w_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS w_end,
       count(*) AS n, round(avg({_SCORE.format(c='cls')}), 6) AS mean_score
FROM (SELECT ts, {_EV_CLASS} AS cls FROM events) WHERE cls IS NOT NULL GROUP BY ALL"""
