"""Whole analyses: the reference's pipeline as one lazily planned job graph.

``analyze_posts`` de-duplicates first (dedup never reads sentiment, so the
order does not change results and scoring fewer posts is cheaper), projects
``posts_flat`` once, persists it (narrow columns only, no text), and returns
every statistic and series as a named DataFrame.  Nothing is computed until
a result is written.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from chorus.operators import aggregate as A
from chorus.operators import dedup as D
from chorus.operators import project as P
from chorus.operators import series as S


def statistics(flat: DataFrame, posts: DataFrame | None = None) -> dict[str, DataFrame]:
    """A1–A21 over one flat frame."""
    out = {
        "date_range": A.date_range(flat),
        "by_platform": A.by_platform(flat),
        "by_query": A.by_query(flat),
        "sentiment_distribution": A.sentiment_distribution(flat),
        "sentiment_summary": A.sentiment_summary(flat),
        "sentiment_by_platform": A.sentiment_by(flat, "platform"),
        "sentiment_by_query": A.sentiment_by(flat, "query"),
        "engagement": A.engagement_stats(flat),
        "authors": A.author_stats(flat),
        "most_active_authors": A.most_active_authors(flat),
        "content": A.content_stats(flat),
        "posts_by_hour": A.posts_by_hour(flat),
        "posts_by_day_of_week": A.posts_by_day_of_week(flat),
        "posts_by_date": A.posts_by_date(flat),
        "temporal": A.temporal_summary(flat),
        "high_activity_hours": A.high_activity_hours(flat),
        "negative_users": A.negative_users(flat),
        "sentiment_leaders": A.sentiment_leaders(flat),
    }
    if posts is not None:
        out["top_hashtags"] = A.top_terms(posts, "hashtags")
        out["hashtag_summary"] = A.term_summary(posts, "hashtags", 10)
        out["top_mentions"] = A.top_terms(posts, "mentions")
        out["mention_summary"] = A.term_summary(posts, "mentions", 5)
    return out


def time_series(flat: DataFrame) -> dict[str, DataFrame]:
    """T2–T19 over one flat frame."""
    return {
        "daily_sentiment": S.daily_sentiment(flat),
        "hourly_sentiment": S.hourly_sentiment(flat),
        "trends": S.daily_trend(flat),
        "trend_summary": S.trend_summary(flat),
        "turning_points": S.turning_points(flat),
        "anomalies": S.anomalies(flat),
        "volatility": S.volatility(flat),
        "peak_hours": S.peak_hours(flat),
        "peak_summary": S.peak_summary(flat),
        "periodicity": S.periodicity(flat),
        "periodicity_summary": S.periodicity_summary(flat),
        "recent_distribution": S.recent_distribution(flat),
        "forecast": S.forecast_indicators(flat),
    }


def analyze_posts(posts: DataFrame, dedup: bool = True) -> dict[str, DataFrame]:
    """Dedup → flat (persisted) → statistics + time series + dedup stats.

    Text is read twice: once to hash contents for dedup, once for the ≤ 20
    viral previews.  Shuffles carry only the narrow flat columns.
    """
    results: dict[str, DataFrame] = {}
    # one narrow projection (no text) feeds every statistic; metadata carries hashtags/mentions
    flat = P.posts_flat(posts, keep=["metadata"])
    if dedup:
        flags = D.dedup_flags(posts)
        results["deduplication"] = D.dedup_stats(flags)
        flat = flat.join(flags.filter("kept").select("seq"), "seq", "left_semi")
    flat = flat.persist(StorageLevel.MEMORY_AND_DISK)
    results.update(statistics(flat, flat))
    results["viral_posts"] = A.viral_posts(flat, posts)
    results.update({f"ts_{k}": v for k, v in time_series(flat).items()})
    return results
