"""P15 and the narrow projections every analysis reads.

``posts_flat`` is the one analytic projection: a single ``select`` over the
post schema.  Downstream operators reference only the columns they need, so
Catalyst prunes the rest down to the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.functions import columns as C

FLAT_COLUMNS = [
    "seq", "id", "platform", "author", "author_id", "timestamp", "query", "sentiment",
    "sentiment_score", "sentiment_method", "sentiment_value", "has_sentiment", "engagement_total",
    "likes", "shares", "replies", "content_length", "has_title", "hashtag_count", "mention_count",
    "has_media", "hour", "day_of_week", "date", "subreddit",
]


def posts_flat(posts: DataFrame, keep=()) -> DataFrame:
    """One row per post with the analytic columns.

    Missing sentiment becomes label ``UNKNOWN``, score 0.0, method
    ``unknown``; missing engagement counts as 0.  Raw columns named in
    ``keep`` (e.g. ``content``, ``url``) are carried along unchanged.
    """
    sent = F.col("sentiment")
    label = F.coalesce(sent["label"], F.lit("UNKNOWN"))
    md = F.col("metadata")
    size0 = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return posts.select(
        "seq", "id", "platform", "author", "author_id", "timestamp", "query",
        F.when(sent.isNull(), F.lit("UNKNOWN")).otherwise(label).alias("sentiment"),
        F.when(sent.isNull(), F.lit(0.0)).otherwise(F.coalesce(sent["score"], F.lit(0.0))).alias("sentiment_score"),
        F.when(sent.isNull(), F.lit("unknown")).otherwise(F.coalesce(sent["method"], F.lit("unknown")))
         .alias("sentiment_method"),
        C.label_value(F.when(sent.isNull(), F.lit("UNKNOWN")).otherwise(label)).alias("sentiment_value"),
        sent.isNotNull().alias("has_sentiment"),
        C.engagement_total().alias("engagement_total"),
        C.likes().alias("likes"),
        C.shares().alias("shares"),
        C.replies().alias("replies"),
        F.char_length(F.coalesce(F.col("content"), F.lit(""))).cast("bigint").alias("content_length"),
        (F.coalesce(F.length("title"), F.lit(0)) > 0).alias("has_title"),
        size0(md["hashtags"]).alias("hashtag_count"),
        size0(md["mentions"]).alias("mention_count"),
        (size0(md["media_types"]) > 0).alias("has_media"),
        F.hour("timestamp").cast("bigint").alias("hour"),
        C.weekday_name().alias("day_of_week"),
        F.to_date("timestamp").alias("date"),
        md["subreddit"].alias("subreddit"),
        *[F.col(k) for k in keep],
    )


def text_features(posts: DataFrame, text_col: str = "content") -> DataFrame:
    """P10: simple text features of each post, computed natively."""
    from chorus.functions import text as X
    t = F.coalesce(F.col(text_col), F.lit(""))
    return posts.select("seq", "id", "platform", *X.text_feature_columns(t))
