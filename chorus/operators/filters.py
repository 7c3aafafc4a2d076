"""Filters, limits and query-list preparation.

Predicates on plain columns (timestamp, author, label) are pushed to the
parquet scan by Catalyst; per-group limits plan as a WindowGroupLimit that
trims each group before the shuffle.
"""

from __future__ import annotations

import datetime as dt
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.functions import columns as C


def in_date_range(df: DataFrame, start, end, ts: str = "timestamp") -> DataFrame:
    """``start <= ts <= end`` (both inclusive, naive timestamps)."""
    lo, hi = C.ntz_literal(start), C.ntz_literal(end)
    return df.filter(F.col(ts).between(lo, hi))


def time_filter_bucket(start, end) -> Column:
    """API time filter for a span: day / week / month / year / all."""
    s = start if isinstance(start, Column) else C.ntz_literal(start)
    e = end if isinstance(end, Column) else C.ntz_literal(end)
    days = F.floor(C.micros_between(s, e) / F.lit(86_400_000_000))
    return (F.when(days <= 1, F.lit("day")).when(days <= 7, F.lit("week")).when(days <= 30, F.lit("month"))
             .when(days <= 365, F.lit("year")).otherwise(F.lit("all")))


def lookback_range(days: int, now: dt.datetime):
    """``(now − days, now)``; an empty or inverted range is an error, > 365 days warns."""
    start = now - dt.timedelta(days=days)
    if start >= now:
        raise ValueError(f"Start date must be before end date: {start} >= {now}")
    if (now - start).days > 365:
        warnings.warn("Date range exceeds 365 days. Results may be limited.", stacklevel=2)
    return start, now


def limit_per_query(df: DataFrame, n: int, key: str = "query") -> DataFrame:
    """at most ``n`` posts per query, newest first (ties: platform, id, input order)."""
    w = Window.partitionBy(key).orderBy(F.col("timestamp").desc(), "platform", "id", "seq")
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def limit_per_subreddit(df: DataFrame, n: int, total: int | None = None) -> DataFrame:
    """F4 for reddit: at most ``n`` posts per (query, subreddit), newest first; subreddits are taken in name
    order, whole, until a query has ``total`` posts (the one that reaches it is the last)."""
    sub = F.coalesce(F.col("metadata.subreddit"), F.lit(""))
    w = Window.partitionBy("query", sub).orderBy(F.col("timestamp").desc(), "id", "seq")
    taken = df.withColumn("_sub", sub).withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")
    if total is None:
        return taken.drop("_sub")
    per = taken.groupBy("query", "_sub").agg(F.count(F.lit(1)).alias("_n"))  # one row per query and subreddit
    before = F.sum("_n").over(Window.partitionBy("query").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1))
    open_ = per.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < total).select(
        F.col("query").alias("_q"), F.col("_sub").alias("_s"))
    return taken.join(open_, F.col("query").eqNullSafe(F.col("_q")) & (F.col("_sub") == F.col("_s")), "left_semi").drop("_sub")


def user_timeline(df: DataFrame, user: str, start, end, include_replies: bool = False,
                  limit: int = 100) -> DataFrame:
    """one author's posts in range, newest first; ``query`` becomes ``@user`` / ``u/user``."""
    f = in_date_range(df.filter(F.col("author") == user), start, end)
    if not include_replies:
        f = f.filter(~F.coalesce(F.col("metadata.is_reply"), F.lit(False)))
    q = F.when(F.col("platform") == "reddit", F.lit(f"u/{user}")).otherwise(F.lit(f"@{user}"))
    return f.orderBy(F.col("timestamp").desc(), "seq").limit(limit).withColumn("query", q)


def clean_query(q) -> Column:
    """collapse whitespace runs and trim."""
    from chorus.functions.text import collapse_space
    return collapse_space(q if isinstance(q, Column) else F.col(q))


def distinct_queries(queries: DataFrame, col: str = "query", order: str = "pos") -> DataFrame:
    """case-insensitive distinct, keeping the first spelling; empties dropped."""
    c = queries.select(clean_query(col).alias("q"), F.col(order).alias("pos")).filter(F.length("q") > 0)
    return c.groupBy(F.lower("q").alias("key")).agg(F.min_by("q", "pos").alias(col), F.min("pos").alias("pos")) \
            .select(col, "pos")


def validate_queries(queries: DataFrame, col: str = "query") -> DataFrame:
    """drop queries shorter than 2, cut at 100, remove ``\\``, control whitespace → space.

    Returns the cleaned ``query`` (null when skipped) and a ``warning`` text.
    """
    q = F.trim(F.col(col))
    cut = F.substring(q, 1, 100)
    special = cut.rlike(r"[\\\n\r\t]")
    fixed = F.translate(F.regexp_replace(cut, r"\\", ""), "\n\r\t", "   ")
    short = F.char_length(q) < 2
    warning = (F.when(F.char_length(q) == 0, F.lit(None))
                .when(short, F.concat(F.lit("Query too short (skipped): '"), q, F.lit("'")))
                .when(F.char_length(q) > 100, F.concat(F.lit("Query truncated: '"), F.substring(q, 1, 50),
                                                       F.lit("...'")))
                .when(special, F.concat(F.lit("Special characters removed from: '"), cut, F.lit("'"))))
    valid = F.when((F.char_length(q) == 0) | short, F.lit(None)).otherwise(fixed)
    return queries.select("*", valid.alias("valid_query"), warning.alias("warning"))


def dashboard_filter(df: DataFrame, start_date, end_date, score_min: float = -1.0, score_max: float = 1.0,
                     end_inclusive_day: bool = False) -> DataFrame:
    """F8: ``start 00:00 <= ts <= end 00:00`` and score within bounds.

    The reference compares with midnight of the end day, losing later posts
    of that day; ``end_inclusive_day=True`` keeps the whole day.
    """
    lo = F.lit(start_date).cast("date").cast("timestamp_ntz")
    hi = F.lit(end_date).cast("date").cast("timestamp_ntz")
    ts = F.col("timestamp")
    in_range = (ts >= lo) & ((ts < F.date_add(F.lit(end_date).cast("date"), 1).cast("timestamp_ntz"))
                             if end_inclusive_day else (ts <= hi))
    score = F.coalesce(F.col("sentiment.score"), F.lit(0.0)) if "sentiment" in df.columns and \
        "score" in str(df.schema["sentiment"].dataType) else F.coalesce(F.col("sentiment_score"), F.lit(0.0))
    return df.filter(ts.isNotNull() & in_range & score.between(score_min, score_max))


def sentiment_filter(df: DataFrame, label: str) -> DataFrame:
    """posts whose sentiment label equals ``label``."""
    return df.filter(F.col("sentiment.label") == label)


def scatter_sample(posts: DataFrame, n: int = 1000, min_posts: int = 10) -> DataFrame:
    """the first ``n`` posts (input order) that have a sentiment, if ≥ ``min_posts`` posts."""
    total = posts.select(F.count(F.lit(1))).scalar()
    e = (F.coalesce(F.try_element_at("engagement", F.lit("likes")), F.lit(0.0))
         + F.coalesce(F.try_element_at("engagement", F.lit("retweets")), F.lit(0.0)))
    # cut to the result's columns first: every task hands its first n posts to the last one, without their whole texts
    narrow = posts.select("seq", C.iso_timestamp("timestamp").alias("timestamp"), e.alias("engagement"),
                          F.coalesce(F.col("sentiment.score"), F.lit(0.0)).alias("sentiment_score"),
                          F.coalesce(F.col("sentiment.label"), F.lit("UNKNOWN")).alias("sentiment_label"),
                          "author", F.concat(F.substring("content", 1, 100), F.lit("...")).alias("content_preview"),
                          F.col("sentiment").isNotNull().alias("_scored"))
    return narrow.orderBy("seq").limit(n).filter(F.col("_scored") & (total >= min_posts)).drop("_scored")
