"""Posts derived from the driver's parquet tables.

The test inputs are generic tables (``events``, ``documents``, ``labels``);
this module turns them into a post dataset with Spark joins, so every query
built on it scales with those tables.  The same rows are produced by
:data:`POSTS_SQL` (portable SQL, used as the leading CTE of every DuckDB
oracle query).  Rules, per event ``e`` and document ``d = e.event_id mod
count(documents)``:

* ids repeat: every event with ``event_id mod 50 = 4`` reuses the id of the
  event three before it (same platform), so exact-id duplicates exist;
* ``event_id mod 3 = 0`` is a reddit post (title, subreddit, score,
  num_comments, upvote ratio 0.75), the rest are tweets;
* content is the **whole** document text; most posts append a hashtag, a
  mention, a URL and a unique marker, posts with ``event_id mod 10 < 2`` keep
  the bare text (content duplicates); for the dedup queries
  ``event_id mod 41 = 0`` is empty;
* labels come from ``labels`` (toxic → NEGATIVE, quality → POSITIVE/NEUTRAL),
  else from the event type; ``event_id mod 97 = 0`` is never scored
  (``sentiment`` null);
* for the time-series queries two calendar days are left out, which makes gaps.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.functions.columns import ntz_literal
from chorus.schema import engagement_map, metadata_struct, sentiment_struct

GAP_DAYS = ("2024-01-09", "2024-01-20")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_flat(spark: SparkSession, sf_dir: str, gaps: bool = False, blanks: bool = False) -> DataFrame:
    """Flat post rows (one column per counter) — the Spark twin of POSTS_SQL.

    ``gaps`` leaves out two days (the time-series queries need empty days), ``blanks`` empties the
    text of every 41st event (the dedup queries need posts without text); all others read it all.
    """
    events = read_table(spark, sf_dir, "events")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    n_docs = docs.select(F.count(F.lit(1))).scalar()

    ts = F.col("ts")
    in_gap = None
    for d in GAP_DAYS:  # range predicates, so the filter reaches the parquet scan
        start = dt.datetime.fromisoformat(d)
        day = (ts >= ntz_literal(start)) & (ts < ntz_literal(start + dt.timedelta(days=1)))
        in_gap = day if in_gap is None else in_gap | day
    e = events.filter(~in_gap) if gaps else events
    # the side that holds the text is spread: whichever way the join goes, one row group must not mean one task
    width = 2 * spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < width:
        docs = docs.repartition(width, "doc_id")
    e = e.withColumn("doc_key", F.col("event_id") % n_docs)
    joined = (e.join(docs, e.doc_key == docs.doc_id, "inner")
               .join(labels, "doc_id", "left"))

    eid = F.col("event_id")
    is_reddit = eid % 3 == 0
    uid = F.col("user_id").cast("string")
    content = (F.when((eid % 41 == 0) & F.lit(blanks), F.lit(""))
                .when(eid % 10 < 2, F.col("text"))
                .otherwise(F.concat(F.col("text"), F.lit(" #"), F.col("event_type"),
                                    F.lit(" @user"), (F.col("user_id") % 7).cast("string"),
                                    F.lit(" https://x.example/"), eid.cast("string"),
                                    F.lit(" n"), eid.cast("string"))))
    sentiment = (F.when(eid % 97 == 0, F.lit("UNKNOWN"))
                  .when(F.col("toxic") == 1, F.lit("NEGATIVE"))
                  .when(F.col("quality") == 1, F.lit("POSITIVE"))
                  .when(F.col("quality") == 0, F.lit("NEUTRAL"))
                  .when((F.col("event_type") == "error") | (F.col("user_id") % 9 == 0), F.lit("NEGATIVE"))
                  .when(F.col("event_type") == "purchase", F.lit("POSITIVE"))
                  .otherwise(F.lit("NEUTRAL")))
    return joined.select(
        (eid - F.when(eid % 50 == 4, 3).otherwise(0)).cast("string").alias("id"),
        F.when(is_reddit, "reddit").otherwise("twitter").alias("platform"),
        F.when(eid % 101 == 0, F.lit("[deleted]")).otherwise(F.concat(F.lit("user"), uid)).alias("author"),
        uid.alias("author_id"),
        content.alias("content"),
        F.when(is_reddit, F.concat(F.lit("About "), F.col("source"))).alias("title"),
        F.col("ts"),
        F.when(~is_reddit, F.floor("value").cast("bigint")).alias("likes"),
        F.when(~is_reddit, eid % 13).alias("retweets"),
        F.when(~is_reddit, eid % 5).alias("replies"),
        F.when(is_reddit, F.floor(F.col("value") * 2).cast("bigint")).alias("score"),
        F.when(is_reddit, eid % 29).alias("num_comments"),
        F.when(is_reddit, F.lit(0.75)).alias("upvote_ratio"),
        F.col("event_type").alias("query"),
        F.when(is_reddit, F.col("source")).alias("subreddit"),
        F.when(~is_reddit & (eid % 2 == 0), F.col("event_type")).alias("hashtag1"),
        F.when(eid % 6 == 2, F.col("source")).alias("hashtag2"),
        F.when(eid % 3 == 1, F.concat(F.lit("user"), ((F.col("user_id") + eid % 4) % 50).cast("string")))
         .alias("mention1"),
        sentiment.alias("sentiment"),
        ((eid % 100).cast("double") / 100).alias("sentiment_score"),
        eid.alias("seq"),
    )


def fixture_posts(spark: SparkSession, sf_dir: str, gaps: bool = False, blanks: bool = False) -> DataFrame:
    """Posts in the canonical schema (``chorus.schema.POST_SCHEMA``)."""
    flat = fixture_flat(spark, sf_dir, gaps, blanks)
    score = F.col("score").cast("double")
    ratio = F.col("upvote_ratio")
    engagement = F.when(
        F.col("platform") == "reddit",
        engagement_map(score=score,
                       upvotes=F.floor(score * ratio),
                       downvotes=F.floor(score * (F.lit(1.0) - ratio)),
                       num_comments=F.col("num_comments"),
                       upvote_ratio=ratio),
    ).otherwise(engagement_map(likes=F.col("likes"), retweets=F.col("retweets"),
                               replies=F.col("replies")))
    non_null = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    metadata = metadata_struct(hashtags=non_null(F.col("hashtag1"), F.col("hashtag2")),
                               mentions=non_null(F.col("mention1")),
                               subreddit=F.col("subreddit"))
    sentiment = F.when(F.col("sentiment") != "UNKNOWN",
                       sentiment_struct(F.col("sentiment"), F.col("sentiment_score"), F.lit("fixture")))
    url = F.concat(F.lit("https://"), F.col("platform"), F.lit(".example/"), F.col("id"))
    return flat.select(
        F.col("seq"), F.col("id"), F.col("platform"), F.col("author"), F.col("author_id"),
        F.col("content"), F.col("title"), F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        engagement.alias("engagement"), url.alias("url"), F.col("query"),
        metadata.alias("metadata"), sentiment.alias("sentiment"))


# Portable SQL producing the same flat rows (DuckDB and Spark SQL).  Oracle
# queries start with ``WITH posts AS (POSTS_SQL), flat AS (FLAT_SQL)``.
POSTS_SQL = """
SELECT
  CAST(e.event_id - CASE WHEN e.event_id % 50 = 4 THEN 3 ELSE 0 END AS VARCHAR) AS id,
  CASE WHEN e.event_id % 3 = 0 THEN 'reddit' ELSE 'twitter' END AS platform,
  CASE WHEN e.event_id % 101 = 0 THEN '[deleted]' ELSE 'user' || CAST(e.user_id AS VARCHAR) END AS author,
  CAST(e.user_id AS VARCHAR) AS author_id,
  CASE WHEN e.event_id % 41 = 0 AND {blanks} THEN ''
       WHEN e.event_id % 10 < 2 THEN d.text
       ELSE d.text || ' #' || e.event_type || ' @user' || CAST(e.user_id % 7 AS VARCHAR)
            || ' https://x.example/' || CAST(e.event_id AS VARCHAR) || ' n' || CAST(e.event_id AS VARCHAR) END AS content,
  CASE WHEN e.event_id % 3 = 0 THEN 'About ' || d.source END AS title,
  e.ts AS ts,
  CASE WHEN e.event_id % 3 <> 0 THEN CAST(floor(e.value) AS BIGINT) END AS likes,
  CASE WHEN e.event_id % 3 <> 0 THEN e.event_id % 13 END AS retweets,
  CASE WHEN e.event_id % 3 <> 0 THEN e.event_id % 5 END AS replies,
  CASE WHEN e.event_id % 3 = 0 THEN CAST(floor(e.value * 2) AS BIGINT) END AS score,
  CASE WHEN e.event_id % 3 = 0 THEN e.event_id % 29 END AS num_comments,
  CASE WHEN e.event_id % 3 = 0 THEN CAST(0.75 AS DOUBLE) END AS upvote_ratio,
  e.event_type AS query,
  CASE WHEN e.event_id % 3 = 0 THEN d.source END AS subreddit,
  CASE WHEN e.event_id % 3 <> 0 AND e.event_id % 2 = 0 THEN e.event_type END AS hashtag1,
  CASE WHEN e.event_id % 6 = 2 THEN d.source END AS hashtag2,
  CASE WHEN e.event_id % 3 = 1 THEN 'user' || CAST((e.user_id + e.event_id % 4) % 50 AS VARCHAR) END AS mention1,
  CASE WHEN e.event_id % 97 = 0 THEN 'UNKNOWN'
       WHEN l.toxic = 1 THEN 'NEGATIVE'
       WHEN l.quality = 1 THEN 'POSITIVE'
       WHEN l.quality = 0 THEN 'NEUTRAL'
       WHEN e.event_type = 'error' OR e.user_id % 9 = 0 THEN 'NEGATIVE'
       WHEN e.event_type = 'purchase' THEN 'POSITIVE'
       ELSE 'NEUTRAL' END AS sentiment,
  CAST((e.event_id % 100) AS DOUBLE) / 100 AS sentiment_score,
  e.event_id AS seq
FROM (SELECT ev.*, ev.event_id % (SELECT count(*) FROM documents) AS doc_key FROM events ev) e
JOIN documents d ON d.doc_id = e.doc_key
LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE NOT {gaps} OR date_trunc('day', e.ts) NOT IN (TIMESTAMP '2024-01-09', TIMESTAMP '2024-01-20')
"""

# The analytic projection (posts_flat) over POSTS_SQL, in portable SQL.
# UNKNOWN rows are unscored posts: label UNKNOWN, score 0, method unknown.
FLAT_SQL = """
SELECT p.*,
  CASE WHEN p.platform = 'reddit'
       THEN CAST(p.score AS DOUBLE) + trunc(p.score * p.upvote_ratio) + trunc(p.score * (1 - p.upvote_ratio))
            + CAST(p.num_comments AS DOUBLE) + p.upvote_ratio
       ELSE CAST(p.likes + p.retweets + p.replies AS DOUBLE) END AS engagement_total,
  CAST(CASE WHEN p.platform = 'reddit' THEN p.score ELSE p.likes END AS DOUBLE) AS likes_m,
  CAST(CASE WHEN p.platform = 'reddit' THEN p.num_comments ELSE p.retweets END AS DOUBLE) AS shares_m,
  CAST(CASE WHEN p.platform = 'reddit' THEN 0 ELSE p.replies END AS DOUBLE) AS replies_m,
  CAST(CASE WHEN p.sentiment = 'UNKNOWN' THEN 0 ELSE p.sentiment_score END AS DOUBLE) AS score_m,
  CAST(CASE p.sentiment WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END AS DOUBLE) AS sentiment_value,
  CAST(length(p.content) AS BIGINT) AS content_length,
  (p.title IS NOT NULL AND length(p.title) > 0) AS has_title,
  CAST((p.hashtag1 IS NOT NULL)::INT + (p.hashtag2 IS NOT NULL)::INT AS BIGINT) AS hashtag_count,
  CAST((p.mention1 IS NOT NULL)::INT AS BIGINT) AS mention_count,
  CAST(extract(hour FROM p.ts) AS BIGINT) AS hour,
  dayname(p.ts) AS day_of_week,
  strftime(p.ts, '%Y-%m-%d') AS date
FROM posts p
"""


def oracle(body: str, gaps: bool = False, blanks: bool = False) -> str:
    """Wrap an oracle query body with the shared ``posts``/``flat`` CTEs."""
    rows = POSTS_SQL.replace("{gaps}", str(gaps).lower()).replace("{blanks}", str(blanks).lower())
    return f"WITH posts AS ({rows}), flat AS ({FLAT_SQL}) {body}"


def gap_oracle(body: str) -> str:
    return oracle(body, gaps=True)


def blank_oracle(body: str) -> str:
    return oracle(body, blanks=True)
