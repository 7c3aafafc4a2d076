"""Registered queries: each reads the driver tables through the post fixture
and runs one operator (or a small chain) of the library.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name]`` (DuckDB
SQL over the same tables) are what ``__spark_entry__`` exposes.  Doubles are
rounded to 6 decimals on both sides because float sums depend on order.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.functions import text as X
from chorus.operators import aggregate as A
from chorus.operators import dedup as D
from chorus.operators import filters as FL
from chorus.operators import network as G
from chorus.operators import keywords as W
from chorus.operators import sentiment as N
from chorus.operators import project as P
from chorus.operators import series as S
from chorus.sources.fixture import blank_oracle, fixture_posts, gap_oracle, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals."""
    cols = [F.round(F.col(f.name), 6).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_posts(spark, sf_dir)


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.posts_flat(posts(spark, sf_dir))


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat posts without two days, for the time series."""
    return P.posts_flat(fixture_posts(spark, sf_dir, gaps=True))


def blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts with some empty texts, for de-duplication."""
    return fixture_posts(spark, sf_dir, blanks=True)


# --------------------------------------------------------------------------- T: time series

@register("daily_sentiment", gap_oracle("""
SELECT date,
  count(*) FILTER (WHERE sentiment = 'POSITIVE') AS positive,
  count(*) FILTER (WHERE sentiment = 'NEGATIVE') AS negative,
  count(*) FILTER (WHERE sentiment = 'NEUTRAL') AS neutral,
  count(*) AS total,
  round((count_if(sentiment = 'POSITIVE') - count_if(sentiment = 'NEGATIVE')) / count(*), 6) AS sentiment_ratio,
  round(count_if(sentiment = 'POSITIVE') / count(*), 6) AS positive_ratio,
  round(avg(sentiment_value), 6) AS avg_sentiment,
  round(coalesce(stddev_samp(sentiment_value), 0.0), 6) AS sentiment_std,
  CAST(trunc(sum(engagement_total)) AS BIGINT) AS total_engagement,
  round(avg(engagement_total), 6) AS avg_engagement,
  CAST(trunc(max(engagement_total)) AS BIGINT) AS max_engagement,
  count(DISTINCT author) AS unique_authors,
  round(count(*) / count(DISTINCT author), 6) AS posts_per_author
FROM flat GROUP BY date
"""))
def q_daily_sentiment(spark, sf_dir):
    return rounded(S.daily_sentiment(gapped(spark, sf_dir)))


@register("time_grid_daily", gap_oracle("""
, b AS (SELECT date_trunc('day', ts) AS bucket, count(*) AS cnt, avg(sentiment_value) AS v,
               sum(engagement_total) AS es FROM flat GROUP BY 1),
  g AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 DAY)) AS bucket FROM b)
SELECT strftime(g.bucket, '%Y-%m-%d') AS date, CAST(coalesce(b.cnt, 0) AS BIGINT) AS count,
       round(b.v, 6) AS v, round(coalesce(b.es, 0.0), 6) AS engagement_sum
FROM g LEFT JOIN b USING (bucket)
"""))
def q_time_grid_daily(spark, sf_dir):
    g = S.time_grid(gapped(spark, sf_dir), "day")
    return rounded(g.select(F.date_format("bucket", "yyyy-MM-dd").alias("date"), "count", "v", "engagement_sum"))


@register("time_grid_hourly", gap_oracle("""
, b AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS cnt, avg(sentiment_value) AS v FROM flat GROUP BY 1),
  g AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM b)
SELECT strftime(g.bucket, '%Y-%m-%d %H:%M:%S') AS hour, CAST(coalesce(b.cnt, 0) AS BIGINT) AS count,
       round(b.v, 6) AS v
FROM g LEFT JOIN b USING (bucket)
"""))
def q_time_grid_hourly(spark, sf_dir):
    g = S.time_grid(gapped(spark, sf_dir), "hour")
    return rounded(g.select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("hour"), "count", "v"))


@register("hourly_sentiment", gap_oracle("""
SELECT hour, round(avg(sentiment_value), 6) AS avg_sentiment, count(*) AS post_count,
       round(avg(engagement_total), 6) AS avg_engagement
FROM flat GROUP BY hour
"""))
def q_hourly_sentiment(spark, sf_dir):
    return rounded(S.hourly_sentiment(gapped(spark, sf_dir)))


_GRID_SQL = """
, b AS (SELECT date_trunc('day', ts) AS bucket, avg(sentiment_value) AS v FROM flat GROUP BY 1),
  g0 AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 DAY)) AS bucket FROM b),
  g AS (SELECT g0.bucket, b.v, row_number() OVER (ORDER BY g0.bucket) - 1 AS idx,
               count(*) OVER () AS n_buckets, (SELECT count(*) FROM flat) AS n_posts
        FROM g0 LEFT JOIN b USING (bucket))
"""


@register("daily_trend", gap_oracle(_GRID_SQL + """
SELECT strftime(bucket, '%Y-%m-%d') AS date, round(v, 6) AS sentiment_value,
  round(avg(v) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ma_3,
  round(avg(v) OVER (ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma_7
FROM g WHERE n_posts >= 3 AND n_buckets >= 2
"""))
def q_daily_trend(spark, sf_dir):
    return rounded(S.daily_trend(gapped(spark, sf_dir)))


@register("trend_summary", gap_oracle(_GRID_SQL + """
, l AS (SELECT *,
    lag(v, 1) OVER w AS v_1, lag(v, 2) OVER w AS v_2, lag(v, 3) OVER w AS v_3,
    lag(v, 6) OVER w AS v_6, lag(v, 7) OVER w AS v_7,
    v - lag(v, 1) OVER w AS diff
  FROM g WINDOW w AS (ORDER BY idx)),
  r AS (SELECT *,
    avg(greatest(diff, 0.0)) OVER w14 AS avg_gain, avg(greatest(-diff, 0.0)) OVER w14 AS avg_loss,
    count(diff) OVER w14 AS n_diff14,
    count(*) FILTER (WHERE diff > 0) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS up_last3,
    regr_slope(v, CAST(idx AS DOUBLE)) OVER () AS slope, count(v) OVER () AS n_values,
    max(CASE WHEN idx = 0 THEN v END) OVER () AS v_first
  FROM l WINDOW w14 AS (ORDER BY idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
  t AS (SELECT *, (n_posts >= 3 AND n_buckets >= 2) AS enough, v - v_2 AS recent,
    CASE WHEN n_buckets > 1 THEN v - v_1 END AS m1, CASE WHEN n_buckets > 3 THEN v - v_3 END AS m3,
    CASE WHEN n_buckets > 7 THEN v - v_7 END AS m7
  FROM r WHERE idx = n_buckets - 1)
SELECT
  CASE WHEN NOT enough OR n_buckets < 3 OR n_values < 2 THEN 'insufficient_data'
       WHEN abs(slope) < 0.05 AND abs(recent) < 0.1 THEN 'stable'
       WHEN slope > 0.05 OR recent > 0.1 THEN 'improving' ELSE 'worsening' END AS overall_trend,
  round(CASE WHEN enough THEN abs(v - v_first) ELSE 0.0 END, 6) AS trend_strength,
  round(CASE WHEN enough THEN slope END, 6) AS slope,
  round(CASE WHEN enough THEN (CASE WHEN n_buckets >= 7 THEN (v - v_6) / (v_6 + 0.001) * 100 ELSE 0.0 END) END, 6)
    AS rate_of_change,
  round(CASE WHEN enough THEN (CASE WHEN n_buckets < 14 THEN 50.0 WHEN n_diff14 < 14 THEN NULL
       WHEN avg_loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + avg_gain / avg_loss) END) END, 6) AS rsi,
  round(CASE WHEN n_posts >= 2 AND n_buckets >= 2 THEN m1 END, 6) AS momentum_1_day,
  round(CASE WHEN n_posts >= 2 AND n_buckets >= 2 THEN m3 END, 6) AS momentum_3_day,
  round(CASE WHEN n_posts >= 2 AND n_buckets >= 2 THEN m7 END, 6) AS momentum_7_day,
  round(CASE WHEN n_posts >= 2 AND n_buckets >= 2 THEN
        (CASE WHEN n_buckets >= 3 THEN (v - v_1) - (v_1 - v_2) ELSE 0.0 END) END, 6) AS acceleration,
  CASE WHEN n_posts >= 2 AND n_buckets >= 2 THEN
       (CASE WHEN (CASE WHEN n_buckets > 1 THEN m1 ELSE 0.0 END) + (CASE WHEN n_buckets > 3 THEN m3 ELSE 0.0 END)
                  + (CASE WHEN n_buckets > 7 THEN m7 ELSE 0.0 END) > 0 THEN 'positive' ELSE 'negative' END)
       END AS momentum_direction,
  round(CASE WHEN n_posts >= 7 THEN (CASE WHEN n_buckets >= 3 THEN CAST(up_last3 AS DOUBLE) / 3.0 ELSE 0.5 END) END, 6)
    AS trend_consistency,
  CAST(n_buckets AS BIGINT) AS days
FROM t
"""))
def q_trend_summary(spark, sf_dir):
    return rounded(S.trend_summary(gapped(spark, sf_dir)))


@register("turning_points", gap_oracle(_GRID_SQL + """
, l AS (SELECT bucket, v, lag(v) OVER (ORDER BY idx) AS prev, lead(v) OVER (ORDER BY idx) AS nxt,
               n_posts, n_buckets FROM g)
SELECT strftime(bucket, '%Y-%m-%d') AS date,
       CASE WHEN v > prev AND v > nxt THEN 'peak' ELSE 'trough' END AS type, round(v, 6) AS value
FROM l WHERE n_posts >= 3 AND n_buckets >= 3 AND ((v > prev AND v > nxt) OR (v < prev AND v < nxt))
"""))
def q_turning_points(spark, sf_dir):
    return rounded(S.turning_points(gapped(spark, sf_dir)))


@register("anomalies", gap_oracle("""
, d AS (SELECT CAST(ts AS DATE) AS day, avg(sentiment_value) AS v, count(*) AS post_count,
               sum(engagement_total) AS es FROM flat GROUP BY 1),
  s AS (SELECT *, avg(v) OVER () AS mu, stddev_samp(v) OVER () AS sd, sum(post_count) OVER () AS n FROM d),
  z AS (SELECT *, (v - mu) / sd AS z FROM s WHERE n >= 6 AND sd <> 0)
SELECT strftime(day, '%Y-%m-%d') AS date, round(v, 6) AS sentiment_value, round(z, 6) AS z_score,
       CASE WHEN z > 0 THEN 'positive_spike' ELSE 'negative_spike' END AS type,
       post_count, CAST(trunc(es) AS BIGINT) AS total_engagement,
       CASE WHEN abs(z) > 3 THEN 'high' ELSE 'medium' END AS severity
FROM z WHERE abs(z) > 2.0
"""))
def q_anomalies(spark, sf_dir):
    return rounded(S.anomalies(gapped(spark, sf_dir)))


@register("volatility", gap_oracle("""
, dg AS (SELECT unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL 1 DAY)) AS b FROM flat),
  dv AS (SELECT date_trunc('day', ts) AS b, avg(sentiment_value) AS v FROM flat GROUP BY 1),
  d AS (SELECT dg.b, dv.v, lag(dv.v) OVER (ORDER BY dg.b) AS prev FROM dg LEFT JOIN dv USING (b)),
  hg AS (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS b FROM flat),
  hv AS (SELECT date_trunc('hour', ts) AS b, avg(sentiment_value) AS v FROM flat GROUP BY 1),
  h AS (SELECT hg.b, hv.v, lag(hv.v) OVER (ORDER BY hg.b) AS prev FROM hg LEFT JOIN hv USING (b)),
  dr AS (SELECT stddev_samp(CASE WHEN prev <> 0 THEN v / prev - 1 END) AS sd,
                count(CASE WHEN prev <> 0 THEN v / prev - 1 END) AS n_r,
                count(*) FILTER (WHERE prev = 0 AND v <> 0) AS n_inf FROM d),
  hr AS (SELECT stddev_samp(CASE WHEN prev <> 0 THEN v / prev - 1 END) AS sd,
                count(CASE WHEN prev <> 0 THEN v / prev - 1 END) AS n_r,
                count(*) FILTER (WHERE prev = 0 AND v <> 0) AS n_inf FROM h),
  o AS (SELECT stddev_samp(sentiment_value) AS sd, avg(sentiment_value) AS mu, count(*) AS n FROM flat)
SELECT round(CASE WHEN o.n < 2 THEN 0.0 ELSE o.sd END, 6) AS overall,
       round(CASE WHEN o.n < 2 THEN 0.0 WHEN dr.n_inf > 0 THEN NULL WHEN dr.n_r = 0 THEN 0.0 ELSE dr.sd END, 6) AS daily,
       round(CASE WHEN o.n < 2 THEN 0.0 WHEN hr.n_inf > 0 THEN NULL WHEN hr.n_r = 0 THEN 0.0 ELSE hr.sd END, 6) AS hourly,
       round(CASE WHEN o.n < 2 THEN NULL WHEN o.mu <> 0 THEN o.sd / abs(o.mu) ELSE 0.0 END, 6) AS coefficient_of_variation
FROM o, dr, hr
"""))
def q_volatility(spark, sf_dir):
    return rounded(S.volatility(gapped(spark, sf_dir)))


_HOUR_GRID_SQL = """
, hv AS (SELECT date_trunc('hour', ts) AS b, count(*) AS c FROM flat GROUP BY 1),
  hg AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM hv),
  h AS (SELECT hg.b, coalesce(hv.c, 0) AS c FROM hg LEFT JOIN hv USING (b))
"""


@register("peak_hours", gap_oracle(_HOUR_GRID_SQL + """
SELECT strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, CAST(c AS BIGINT) AS post_count,
       CAST(extract(hour FROM b) AS BIGINT) AS hour_of_day, dayname(b) AS day_of_week
FROM h ORDER BY c DESC, b LIMIT 10
"""))
def q_peak_hours(spark, sf_dir):
    return S.peak_hours(gapped(spark, sf_dir))


@register("peak_summary", gap_oracle(_HOUR_GRID_SQL + """
, hs AS (SELECT avg(c) AS avg_posts_per_hour, max(c) AS mx, sum(c) AS total,
                sum(c) FILTER (WHERE rk <= 24) AS top24
         FROM (SELECT c, row_number() OVER (ORDER BY c DESC, b) AS rk FROM h)),
  dv AS (SELECT date_trunc('day', ts) AS b, count(*) AS c FROM flat GROUP BY 1),
  pd AS (SELECT b, c FROM dv ORDER BY c DESC, b LIMIT 1)
SELECT strftime(pd.b, '%Y-%m-%d') AS peak_date, CAST(pd.c AS BIGINT) AS peak_day_posts,
       dayname(pd.b) AS peak_day_of_week, round(hs.avg_posts_per_hour, 6) AS avg_posts_per_hour,
       CAST(hs.mx AS BIGINT) AS max_posts_per_hour, round(hs.top24 / hs.total, 6) AS activity_concentration
FROM hs, pd
"""))
def q_peak_summary(spark, sf_dir):
    return rounded(S.peak_summary(gapped(spark, sf_dir)))


@register("periodicity", gap_oracle("""
, p AS (SELECT 'hour' AS kind, hour AS key, avg(sentiment_value) AS a FROM flat GROUP BY hour
        UNION ALL
        SELECT 'weekday' AS kind, CAST(isodow(ts) - 1 AS BIGINT) AS key, avg(sentiment_value) AS a
        FROM flat GROUP BY 2)
SELECT kind, key, round(a, 6) AS avg_sentiment FROM p WHERE (SELECT count(*) FROM flat) >= 24
"""))
def q_periodicity(spark, sf_dir):
    return rounded(S.periodicity(gapped(spark, sf_dir)))


@register("periodicity_summary", gap_oracle("""
, p AS (SELECT 'hour' AS kind, hour AS key, avg(sentiment_value) AS a FROM flat GROUP BY hour
        UNION ALL
        SELECT 'weekday' AS kind, CAST(isodow(ts) - 1 AS BIGINT) AS key, avg(sentiment_value) AS a
        FROM flat GROUP BY 2)
SELECT kind, round(var_samp(a), 6) AS strength,
       arg_min(key, (-a, key)) AS most_positive, arg_min(key, (a, key)) AS most_negative
FROM p WHERE (SELECT count(*) FROM flat) >= 24 GROUP BY kind
"""))
def q_periodicity_summary(spark, sf_dir):
    return rounded(S.periodicity_summary(gapped(spark, sf_dir)))


@register("recent_distribution", gap_oracle("""
, r AS (SELECT sentiment, count(*) AS n FROM flat
        WHERE ts >= (SELECT max(ts) FROM flat) - INTERVAL 3 DAY AND (SELECT count(*) FROM flat) >= 7
        GROUP BY sentiment)
SELECT sentiment, round(n / sum(n) OVER (), 6) AS share FROM r
"""))
def q_recent_distribution(spark, sf_dir):
    return rounded(S.recent_distribution(gapped(spark, sf_dir)))


@register("forecast_indicators", gap_oracle(_GRID_SQL + """
, l AS (SELECT idx, n_buckets, v - lag(v) OVER (ORDER BY idx) AS diff FROM g),
  tc AS (SELECT CASE WHEN max(n_buckets) >= 3 THEN CAST(count(*) FILTER (WHERE diff > 0 AND idx >= n_buckets - 3) AS DOUBLE) / 3.0
                     ELSE 0.5 END AS trend_consistency FROM l),
  o AS (SELECT sentiment_value, ts, row_number() OVER (ORDER BY ts, seq) - 1 AS rk, count(*) OVER () AS n FROM flat),
  s AS (SELECT max(n) AS n,
               stddev_samp(sentiment_value) FILTER (WHERE rk < n // 2) AS s1,
               stddev_samp(sentiment_value) FILTER (WHERE rk >= n // 2) AS s2,
               arg_max(sentiment_value, rk) AS last_v, arg_max(ts, rk) AS last_ts FROM o)
SELECT round(tc.trend_consistency, 6) AS trend_consistency,
       CASE WHEN s.n < 14 THEN 'unknown' WHEN s.s2 > s.s1 THEN 'increasing' ELSE 'decreasing' END AS volatility_trend,
       round(s.last_v, 6) AS last_sentiment_value, strftime(s.last_ts, '%Y-%m-%d %H:%M:%S.%f') AS last_update
FROM s, tc WHERE s.n >= 7
"""))
def q_forecast_indicators(spark, sf_dir):
    return rounded(S.forecast_indicators(gapped(spark, sf_dir)))


@register("timeline_percent", gap_oracle("""
SELECT date,
  round(count_if(sentiment = 'POSITIVE') * 100.0 / count(*), 6) AS positive_pct,
  round(count_if(sentiment = 'NEGATIVE') * 100.0 / count(*), 6) AS negative_pct,
  round(count_if(sentiment = 'NEUTRAL') * 100.0 / count(*), 6) AS neutral_pct,
  count(*) AS volume,
  round((count_if(sentiment = 'POSITIVE') - count_if(sentiment = 'NEGATIVE')) / count(*), 6) AS sentiment_ratio
FROM flat GROUP BY date
"""))
def q_timeline_percent(spark, sf_dir):
    return rounded(S.timeline_percent(gapped(spark, sf_dir)))


# --------------------------------------------------------------------------- A: aggregations

@register("date_range", oracle("""
SELECT count(*) AS total_posts, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS "end",
       CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) + 1 AS BIGINT) AS days,
       CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000) AS BIGINT) AS total_hours
FROM flat
"""))
def q_date_range(spark, sf_dir):
    return A.date_range(flat(spark, sf_dir))


@register("by_platform", oracle("SELECT platform, count(*) AS count FROM flat GROUP BY platform"))
def q_by_platform(spark, sf_dir):
    return A.by_platform(flat(spark, sf_dir))


@register("by_query", oracle("SELECT query, count(*) AS count FROM flat GROUP BY query"))
def q_by_query(spark, sf_dir):
    return A.by_query(flat(spark, sf_dir))


@register("sentiment_distribution", oracle("""
SELECT sentiment, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM flat), 6) AS percentage
FROM flat GROUP BY sentiment
"""))
def q_sentiment_distribution(spark, sf_dir):
    return rounded(A.sentiment_distribution(flat(spark, sf_dir)))


@register("sentiment_summary", oracle("""
, c AS (SELECT sentiment, count(*) AS n FROM flat GROUP BY sentiment)
SELECT CAST(sum(n) AS BIGINT) AS total,
       round((sum(n) FILTER (WHERE sentiment = 'POSITIVE') - sum(n) FILTER (WHERE sentiment = 'NEGATIVE')) / sum(n), 6)
         AS sentiment_ratio,
       arg_min(sentiment, (-n, sentiment)) AS dominant_sentiment
FROM c
"""))
def q_sentiment_summary(spark, sf_dir):
    return rounded(A.sentiment_summary(flat(spark, sf_dir)))


@register("sentiment_by_platform", oracle(
    "SELECT platform, sentiment, count(*) AS count FROM flat GROUP BY platform, sentiment"))
def q_sentiment_by_platform(spark, sf_dir):
    return A.sentiment_by(flat(spark, sf_dir), "platform")


@register("sentiment_by_query", oracle(
    "SELECT query, sentiment, count(*) AS count FROM flat GROUP BY query, sentiment"))
def q_sentiment_by_query(spark, sf_dir):
    return A.sentiment_by(flat(spark, sf_dir), "query")


@register("engagement_stats", oracle("""
SELECT CAST(sum(likes_m) AS BIGINT) AS total_likes, CAST(sum(shares_m) AS BIGINT) AS total_shares,
       CAST(trunc(sum(engagement_total)) AS BIGINT) AS total_engagement,
       round(avg(likes_m), 6) AS avg_likes, round(avg(shares_m), 6) AS avg_shares,
       round(avg(engagement_total), 6) AS avg_engagement,
       round(quantile_cont(engagement_total, 0.5), 6) AS median_engagement,
       CAST(max(likes_m) AS BIGINT) AS max_likes, CAST(max(shares_m) AS BIGINT) AS max_shares,
       CAST(trunc(max(engagement_total)) AS BIGINT) AS max_engagement,
       round(stddev_samp(engagement_total), 6) AS engagement_std,
       count(*) FILTER (WHERE engagement_total >
           (SELECT avg(engagement_total) + stddev_samp(engagement_total) FROM flat)) AS high_engagement_posts,
       count(*) FILTER (WHERE engagement_total = 0) AS zero_engagement_posts
FROM flat
"""))
def q_engagement_stats(spark, sf_dir):
    return rounded(A.engagement_stats(flat(spark, sf_dir)))


_AUTHORS_SQL = ", a AS (SELECT author, count(*) AS posts FROM flat WHERE author IS NOT NULL GROUP BY author) "


@register("author_stats", oracle(_AUTHORS_SQL + """
SELECT count(*) AS unique_authors, round(avg(posts), 6) AS mean_posts,
       round(quantile_cont(posts, 0.5), 6) AS median_posts, max(posts) AS max_posts,
       round(stddev_samp(posts), 6) AS std_posts,
       count(*) FILTER (WHERE posts = 1) AS single_post_authors,
       count(*) FILTER (WHERE posts >= 10) AS prolific_authors,
       round((SELECT sum(posts) FROM (SELECT posts FROM a ORDER BY posts DESC, author LIMIT 10))
             / (SELECT count(*) FROM flat), 6) AS author_concentration
FROM a
"""))
def q_author_stats(spark, sf_dir):
    return rounded(A.author_stats(flat(spark, sf_dir)))


@register("most_active_authors", oracle(_AUTHORS_SQL + "SELECT author, posts FROM a ORDER BY posts DESC, author LIMIT 20"))
def q_most_active_authors(spark, sf_dir):
    return A.most_active_authors(flat(spark, sf_dir))


@register("content_stats", oracle("""
SELECT round(avg(content_length), 6) AS avg_length, round(quantile_cont(content_length, 0.5), 6) AS median_length,
       max(content_length) AS max_length, min(content_length) AS min_length,
       count(*) FILTER (WHERE hashtag_count > 0) AS with_hashtags,
       count(*) FILTER (WHERE mention_count > 0) AS with_mentions,
       CAST(0 AS BIGINT) AS with_media, count(*) FILTER (WHERE has_title) AS with_title,
       round(avg(CASE WHEN hashtag_count > 0 THEN 1.0 ELSE 0.0 END), 6) AS hashtag_usage_rate,
       round(avg(CASE WHEN mention_count > 0 THEN 1.0 ELSE 0.0 END), 6) AS mention_usage_rate,
       round(avg(hashtag_count), 6) AS avg_hashtags_per_post, round(avg(mention_count), 6) AS avg_mentions_per_post
FROM flat
"""))
def q_content_stats(spark, sf_dir):
    return rounded(A.content_stats(flat(spark, sf_dir)))


@register("posts_by_hour", oracle("SELECT hour, count(*) AS count FROM flat GROUP BY hour"))
def q_posts_by_hour(spark, sf_dir):
    return A.posts_by_hour(flat(spark, sf_dir))


@register("posts_by_day_of_week", oracle("""
, d AS (SELECT * FROM (VALUES ('Monday', 0), ('Tuesday', 1), ('Wednesday', 2), ('Thursday', 3), ('Friday', 4),
                              ('Saturday', 5), ('Sunday', 6)) t(day_of_week, day_index)),
  c AS (SELECT day_of_week, count(*) AS n FROM flat GROUP BY 1)
SELECT d.day_of_week, CAST(d.day_index AS BIGINT) AS day_index, coalesce(c.n, 0) AS count
FROM d LEFT JOIN c USING (day_of_week)
"""))
def q_posts_by_day_of_week(spark, sf_dir):
    return A.posts_by_day_of_week(flat(spark, sf_dir))


@register("posts_by_date", oracle("SELECT date, count(*) AS count FROM flat GROUP BY date"))
def q_posts_by_date(spark, sf_dir):
    return A.posts_by_date(flat(spark, sf_dir))


@register("temporal_summary", oracle("""
SELECT (SELECT hour FROM flat GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1) AS peak_hour,
       (SELECT day_of_week FROM flat GROUP BY day_of_week ORDER BY count(*) DESC, day_of_week LIMIT 1) AS peak_day,
       count(*) FILTER (WHERE day_of_week IN ('Saturday', 'Sunday')) AS weekend_posts,
       count(*) FILTER (WHERE day_of_week NOT IN ('Saturday', 'Sunday')) AS weekday_posts,
       count(*) FILTER (WHERE hour BETWEEN 0 AND 6) AS night_posts,
       count(*) FILTER (WHERE hour BETWEEN 7 AND 18) AS day_posts,
       count(*) FILTER (WHERE hour BETWEEN 19 AND 23) AS evening_posts
FROM flat
"""))
def q_temporal_summary(spark, sf_dir):
    return A.temporal_summary(flat(spark, sf_dir))


@register("high_activity_hours", oracle("""
, h AS (SELECT hour, count(*) AS count FROM flat GROUP BY hour)
SELECT hour, count FROM h WHERE count > (SELECT avg(count) FROM h)
"""))
def q_high_activity_hours(spark, sf_dir):
    return A.high_activity_hours(flat(spark, sf_dir))


_TERMS_SQL = """
, t AS (SELECT lower(x) AS term FROM (SELECT hashtag1 AS x FROM posts UNION ALL SELECT hashtag2 FROM posts) WHERE x IS NOT NULL),
  m AS (SELECT lower(mention1) AS term FROM posts WHERE mention1 IS NOT NULL)
"""


@register("top_hashtags", oracle(_TERMS_SQL + """
SELECT term, count(*) AS count FROM t GROUP BY term ORDER BY count DESC, term LIMIT 20
"""))
def q_top_hashtags(spark, sf_dir):
    return A.top_terms(posts(spark, sf_dir), "hashtags")


@register("hashtag_summary", oracle(_TERMS_SQL + """
, c AS (SELECT term, count(*) AS n FROM t GROUP BY term)
SELECT count(*) AS unique_terms, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_terms,
       count(*) FILTER (WHERE n = 1) AS single_use, count(*) FILTER (WHERE n >= 10) AS frequent FROM c
"""))
def q_hashtag_summary(spark, sf_dir):
    return A.term_summary(posts(spark, sf_dir), "hashtags", 10)


@register("top_mentions", oracle(_TERMS_SQL + """
SELECT term, count(*) AS count FROM m GROUP BY term ORDER BY count DESC, term LIMIT 20
"""))
def q_top_mentions(spark, sf_dir):
    return A.top_terms(posts(spark, sf_dir), "mentions")


@register("mention_summary", oracle(_TERMS_SQL + """
, c AS (SELECT term, count(*) AS n FROM m GROUP BY term)
SELECT count(*) AS unique_terms, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_terms,
       count(*) FILTER (WHERE n = 1) AS single_use, count(*) FILTER (WHERE n >= 5) AS frequent FROM c
"""))
def q_mention_summary(spark, sf_dir):
    return A.term_summary(posts(spark, sf_dir), "mentions", 5)


@register("negative_users", oracle("""
, u AS (SELECT author, count(*) AS post_count,
               count(*) FILTER (WHERE sentiment = 'NEGATIVE') AS negative_posts,
               count(*) FILTER (WHERE sentiment = 'POSITIVE') AS positive_posts,
               count(*) FILTER (WHERE sentiment = 'NEUTRAL') AS neutral_posts,
               avg(score_m) AS avg_sentiment_score, arg_min(platform, seq) AS platform,
               avg(engagement_total) AS avg_engagement
        FROM flat WHERE author IS NOT NULL GROUP BY author)
SELECT author, platform, post_count, round(negative_posts / post_count, 6) AS negative_ratio,
       negative_posts, positive_posts, neutral_posts, round(avg_sentiment_score, 6) AS avg_sentiment_score,
       round(avg_engagement, 6) AS avg_engagement
FROM u WHERE post_count >= 3 AND negative_posts / post_count >= 0.6
ORDER BY negative_posts / post_count DESC, author LIMIT 50
"""))
def q_negative_users(spark, sf_dir):
    return rounded(A.negative_users(flat(spark, sf_dir)))


@register("viral_posts", oracle("""
, th AS (SELECT greatest(CASE WHEN count(*) < 10 THEN quantile_cont(engagement_total, 0.9)
                              ELSE least(quantile_cont(engagement_total, 0.95),
                                         avg(engagement_total) + 2 * stddev_samp(engagement_total)) END,
                         2 * quantile_cont(engagement_total, 0.5)) AS t FROM flat)
SELECT id, platform, author, CAST(trunc(engagement_total) AS BIGINT) AS engagement,
       CAST(likes_m AS BIGINT) AS likes, CAST(shares_m AS BIGINT) AS shares, sentiment,
       CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS content_preview,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, 'https://' || platform || '.example/' || id AS url
FROM flat WHERE engagement_total >= (SELECT t FROM th)
ORDER BY engagement_total DESC, seq LIMIT 20
"""))
def q_viral_posts(spark, sf_dir):
    return A.viral_posts(P.posts_flat(posts(spark, sf_dir), keep=["content", "url"]))


@register("sentiment_leaders", oracle("""
, c AS (SELECT author, sentiment, count(*) AS n FROM flat WHERE author IS NOT NULL GROUP BY 1, 2),
  d AS (SELECT author, arg_min(sentiment, (-n, sentiment)) AS dominant FROM c GROUP BY author),
  u AS (SELECT author, sum(engagement_total) AS total, avg(engagement_total) AS avg_engagement, count(*) AS post_count
        FROM flat WHERE author IS NOT NULL GROUP BY author),
  j AS (SELECT u.*, d.dominant, row_number() OVER (PARTITION BY d.dominant ORDER BY u.total DESC, u.author) AS rank
        FROM u JOIN d USING (author) WHERE u.post_count >= 2 AND d.dominant IN ('POSITIVE', 'NEGATIVE', 'NEUTRAL'))
SELECT lower(dominant) AS sentiment, rank, author, CAST(trunc(total) AS BIGINT) AS total_engagement,
       round(avg_engagement, 6) AS avg_engagement, post_count,
       round(total / (SELECT sum(engagement_total) FROM flat), 6) AS influence_score
FROM j WHERE rank <= 10
"""))
def q_sentiment_leaders(spark, sf_dir):
    return rounded(A.sentiment_leaders(flat(spark, sf_dir)))


_USERS_SQL = """
, s AS (SELECT * FROM flat WHERE sentiment <> 'UNKNOWN'),
  lc AS (SELECT author, sentiment, count(*) AS n FROM s GROUP BY 1, 2),
  tl AS (SELECT author, max(n) AS top_n, arg_max(sentiment, n) AS top_label FROM lc GROUP BY author),
  u AS (SELECT author, count(*) AS post_count,
               count(*) FILTER (WHERE sentiment = 'POSITIVE') AS positive,
               count(*) FILTER (WHERE sentiment = 'NEGATIVE') AS negative,
               count(*) FILTER (WHERE sentiment = 'NEUTRAL') AS neutral,
               sum(engagement_total) AS total_engagement,
               count(DISTINCT query) AS n_topics, count(DISTINCT subreddit) AS n_subreddits, min(seq) AS first_seq
        FROM s GROUP BY author),
  up AS (SELECT u.*, total_engagement / post_count AS avg_engagement,
                (positive - negative) / post_count AS sentiment_score,
                positive / post_count AS positivity_ratio, negative / post_count AS negativity_ratio,
                CASE WHEN tl.top_n / post_count >= 0.7 THEN tl.top_label
                     WHEN tl.top_n / post_count >= 0.4 THEN 'MIXED' ELSE 'NEUTRAL' END AS user_type
         FROM u JOIN tl USING (author))
"""


@register("user_patterns", oracle(_USERS_SQL + """
SELECT author, post_count, positive, negative, neutral, round(total_engagement, 6) AS total_engagement,
       round(avg_engagement, 6) AS avg_engagement, round(sentiment_score, 6) AS sentiment_score,
       round(positivity_ratio, 6) AS positivity_ratio, round(negativity_ratio, 6) AS negativity_ratio,
       user_type, n_topics, n_subreddits, first_seq
FROM up
"""))
def q_user_patterns(spark, sf_dir):
    return rounded(A.user_patterns(flat(spark, sf_dir)))


@register("user_topic_counts", oracle("""
SELECT author, query AS term, count(*) AS count FROM flat
WHERE sentiment <> 'UNKNOWN' AND query IS NOT NULL AND length(query) > 0 GROUP BY 1, 2
"""))
def q_user_topic_counts(spark, sf_dir):
    return A.user_term_counts(flat(spark, sf_dir), "topic")


@register("user_subreddit_counts", oracle("""
SELECT author, subreddit AS term, count(*) AS count FROM flat
WHERE sentiment <> 'UNKNOWN' AND subreddit IS NOT NULL AND length(subreddit) > 0 GROUP BY 1, 2
"""))
def q_user_subreddit_counts(spark, sf_dir):
    return A.user_term_counts(flat(spark, sf_dir), "subreddit")


@register("engagement_heatmap", oracle("""
SELECT dayname(ts) AS day, CAST(extract(hour FROM ts) AS BIGINT) AS hour,
       round(avg(coalesce(likes, 0) + coalesce(retweets, 0)), 6) AS avg_engagement
FROM posts GROUP BY 1, 2
"""))
def q_engagement_heatmap(spark, sf_dir):
    return rounded(A.engagement_heatmap(posts(spark, sf_dir)))


@register("topic_sentiment_heatmap", oracle("""
, s AS (SELECT * FROM flat WHERE sentiment <> 'UNKNOWN'),
  u AS (SELECT author, count(*) AS post_count, min(seq) AS first_seq FROM s GROUP BY author
        HAVING count(*) >= 2 ORDER BY first_seq LIMIT 30)
SELECT s.author, u.post_count, s.query AS topic, round(avg(s.sentiment_value), 6) AS avg_sentiment, count(*) AS posts
FROM s JOIN u USING (author) GROUP BY s.author, u.post_count, s.query
"""))
def q_topic_sentiment_heatmap(spark, sf_dir):
    return rounded(A.topic_sentiment_heatmap(flat(spark, sf_dir)))


@register("user_leaderboards", oracle(_USERS_SQL + """
, b AS (
  SELECT 'most_posts' AS board, author, CAST(post_count AS DOUBLE) AS value, first_seq FROM up WHERE post_count >= 2
  UNION ALL SELECT 'most_positive', author, positivity_ratio, first_seq FROM up
    WHERE post_count >= 3 AND positivity_ratio > 0.5
  UNION ALL SELECT 'most_negative', author, negativity_ratio, first_seq FROM up
    WHERE post_count >= 3 AND negativity_ratio > 0.5
  UNION ALL SELECT 'top_engagement', author, avg_engagement, first_seq FROM up WHERE post_count >= 2),
  r AS (SELECT board, row_number() OVER (PARTITION BY board ORDER BY value DESC, first_seq) AS rank, author, value FROM b)
SELECT board, rank, author, round(value, 6) AS value FROM r WHERE rank <= 20
"""))
def q_user_leaderboards(spark, sf_dir):
    return rounded(A.user_leaderboards(flat(spark, sf_dir)))


# --------------------------------------------------------------------------- P: text projections

def _sql_norm(expr: str) -> str:
    """The P7 chain in DuckDB syntax (same RE2-compatible classes)."""
    t = f"lower(coalesce({expr}, ''))"
    t = f"regexp_replace({t}, '{X.URL}', '', 'g')"
    t = f"regexp_replace({t}, '{X.MENTION}', '', 'g')"
    t = f"regexp_replace({t}, '{X.HASHTAG}', '\\1', 'g')"
    t = f"regexp_replace({t}, '{X.NOT_WORD_OR_SPACE}', ' ', 'g')"
    return f"trim(regexp_replace({t}, '{X.SPACE}+', ' ', 'g'))"


def _sql_count(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '{pattern}')) AS BIGINT)"


@register("content_hash", oracle(f"""
SELECT seq, sha256({_sql_norm('content')}) AS content_hash, length({_sql_norm('content')}) AS normalized_length
FROM posts
"""))
def q_content_hash(spark, sf_dir):
    p = posts(spark, sf_dir)
    norm = X.normalize_content("content")
    return p.select("seq", F.sha2(norm, 256).alias("content_hash"), F.char_length(norm).cast("bigint").alias("normalized_length"))


@register("text_features", oracle(f"""
SELECT seq,
  regexp_matches(content, '{X.URL}') AS has_urls,
  {_sql_count('content', X.MENTION)} AS num_mentions,
  {_sql_count('content', X.HASHTAG)} AS num_hashtags,
  {_sql_count('content', X.EMOJI_RANGES)} AS num_emojis,
  CAST(length(content) AS BIGINT) AS text_length,
  {_sql_count('content', X.NON_SPACE + '+')} AS num_words,
  {_sql_count('content', '!')} AS exclamation_marks,
  {_sql_count('content', '[?]')} AS question_marks,
  round({_sql_count('content', X.UPPER)} / greatest(length(content), 1), 6) AS all_caps_ratio
FROM posts
"""))
def q_text_features(spark, sf_dir):
    p = posts(spark, sf_dir)
    t = F.coalesce(F.col("content"), F.lit(""))
    return rounded(p.select("seq", *X.text_feature_columns(t)))


@register("clean_text", oracle(f"""
SELECT seq, md5(c) AS cleaned_md5, CAST(length(c) AS BIGINT) AS cleaned_length
FROM (SELECT seq, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        CASE WHEN title IS NOT NULL AND length(title) > 0 THEN title || ' ' || content ELSE content END,
        '{X.URL}', '', 'g'), '@({X.WORD}+)', '\\1', 'g'), '{X.HASHTAG}', '\\1', 'g'), '{X.SPACE}+', ' ', 'g')) AS c
      FROM posts)
"""))
def q_clean_text(spark, sf_dir):
    from chorus.functions import columns as C
    p = posts(spark, sf_dir)
    c = X.clean_text(C.scoring_text())
    return p.select("seq", F.md5(c).alias("cleaned_md5"), F.char_length(c).cast("bigint").alias("cleaned_length"))


@register("post_entities", oracle(f"""
SELECT seq,
  array_to_string(CASE WHEN hashtag1 IS NOT NULL OR hashtag2 IS NOT NULL
                       THEN list_filter([hashtag1, hashtag2], lambda x: x IS NOT NULL)
                       ELSE regexp_extract_all(content, '{X.HASHTAG}', 1) END, '|') AS hashtags,
  array_to_string(CASE WHEN mention1 IS NOT NULL THEN [mention1]
                       ELSE regexp_extract_all(content, '@({X.WORD}+)', 1) END, '|') AS mentions,
  array_to_string(regexp_extract_all(content, '{X.URL_STRICT.replace("'", "''")}', 0), '|') AS urls
FROM posts
"""))
def q_post_entities(spark, sf_dir):
    from chorus.sources.ingest import with_entities
    return with_entities(posts(spark, sf_dir)).select(
        "seq", F.array_join("metadata.hashtags", "|").alias("hashtags"),
        F.array_join("metadata.mentions", "|").alias("mentions"),
        F.array_join("metadata.urls", "|").alias("urls"))


# --------------------------------------------------------------------------- D: de-duplication

_DEDUP_SQL = f"""
, k AS (SELECT seq, platform || ':' || id AS id_key, sha256({_sql_norm('content')}) AS hash_key, query FROM posts),
  r AS MATERIALIZED (SELECT * FROM (
    WITH RECURSIVE rounds(it, seq, id_key, hash_key, st) AS (
      SELECT 0, seq, id_key, hash_key, 0 FROM k
      UNION ALL
      SELECT it + 1, seq, id_key, hash_key,
             CASE WHEN st <> 0 THEN st WHEN win THEN 1
                  WHEN max(win::INT) OVER (PARTITION BY id_key) = 1
                    OR max(win::INT) OVER (PARTITION BY hash_key) = 1 THEN 2
                  ELSE 0 END
      FROM (SELECT *, st = 0 AND seq = min(CASE WHEN st = 0 THEN seq END) OVER (PARTITION BY id_key)
                             AND seq = min(CASE WHEN st = 0 THEN seq END) OVER (PARTITION BY hash_key) AS win,
                   count(*) FILTER (WHERE st = 0) OVER () AS n_und
            FROM rounds) x
      WHERE n_und > 0)
    SELECT * FROM rounds) y
    QUALIFY it = max(it) OVER ()),
  t AS (SELECT r.seq, r.st = 1 AS kept, r.id_key, r.hash_key,
               min(CASE WHEN r.st = 1 THEN r.seq END) OVER (PARTITION BY r.id_key) AS id_seq FROM r),
  tagged AS (SELECT t.seq, t.kept, CASE WHEN t.kept THEN NULL WHEN t.id_seq < t.seq THEN 'exact_id' ELSE 'content' END
                    AS dup_type, k.query FROM t JOIN k USING (seq))
"""


@register("dedup_flags", blank_oracle(_DEDUP_SQL + "SELECT seq, kept, dup_type FROM tagged"))
def q_dedup_flags(spark, sf_dir):
    return D.dedup_flags(blanked(spark, sf_dir)).select("seq", "kept", "dup_type")


@register("dedup_stats", blank_oracle(_DEDUP_SQL + """
SELECT count(*) AS total_posts, count(*) FILTER (WHERE kept) AS unique_posts,
       count(*) FILTER (WHERE NOT kept) AS duplicates_removed,
       round(count(*) FILTER (WHERE NOT kept) / count(*), 6) AS duplicate_rate,
       count(*) FILTER (WHERE dup_type = 'exact_id') AS exact_id_duplicates,
       count(*) FILTER (WHERE dup_type = 'content') AS content_duplicates,
       CAST(0 AS BIGINT) AS fuzzy_duplicates,
       count(*) FILTER (WHERE dup_type IN ('content', 'fuzzy')) AS cross_query_duplicates
FROM tagged
"""))
def q_dedup_stats(spark, sf_dir):
    return rounded(D.dedup_stats(D.dedup_flags(blanked(spark, sf_dir))))


@register("dedup_fuzzy")  # the matcher's ratio is beyond SQL; tests hold it against the sequential pass
def q_dedup_fuzzy(spark, sf_dir):
    return D.dedup_flags(blanked(spark, sf_dir), fuzzy=0.95).select("seq", "kept", "dup_type")


@register("dedup_by_query", blank_oracle(_DEDUP_SQL + """
SELECT query, count(*) AS duplicates FROM tagged WHERE NOT kept GROUP BY query
"""))
def q_dedup_by_query(spark, sf_dir):
    p = blanked(spark, sf_dir)
    return D.dedup_by_query(D.dedup_flags(p).join(p.select("seq", "query"), "seq"))


@register("dedup_cross_flags", blank_oracle(_DEDUP_SQL + """
, kk AS (SELECT t.id_key, t.hash_key, k.query, p.platform FROM t JOIN k USING (seq) JOIN posts p USING (seq) WHERE t.kept),
  dd AS (SELECT t.seq, p.id, p.platform, k.query, tg.dup_type, t.id_key, t.hash_key
         FROM t JOIN k USING (seq) JOIN posts p USING (seq) JOIN tagged tg USING (seq) WHERE NOT t.kept)
SELECT dd.seq, dd.id, dd.platform, dd.query, dd.dup_type,
       CASE WHEN dd.dup_type = 'exact_id' THEN a.platform ELSE b.platform END <> dd.platform AS cross_platform,
       CASE WHEN dd.dup_type = 'exact_id' THEN a.query ELSE b.query END <> dd.query AS cross_query,
       dd.dup_type = 'content' AS compat_cross_platform
FROM dd LEFT JOIN kk a ON a.id_key = dd.id_key LEFT JOIN kk b ON b.hash_key = dd.hash_key
"""))
def q_dedup_cross_flags(spark, sf_dir):
    p = blanked(spark, sf_dir)
    return D.cross_duplicate_flags(D.dedup_flags(p).join(p.select("seq", "id", "platform", "query"), "seq"))


# --------------------------------------------------------------------------- N: sentiment scoring

def _sql_values(name: str, d: dict) -> str:
    rows = ", ".join(f"('{k}', CAST({float(v)} AS DOUBLE))" for k, v in d.items())
    return f"{name}(w, v) AS (SELECT * FROM (VALUES {rows}))"


def _sql_clean(expr: str) -> str:
    t = expr
    for name, cp in {**X.POSITIVE_EMOJI, **X.NEGATIVE_EMOJI}.items():
        t = f"replace({t}, '{cp}', ' {name.strip(':')} ')"
    t = f"regexp_replace({t}, '{X.URL}', '', 'g')"
    t = f"regexp_replace({t}, '@({X.WORD}+)', '\\1', 'g')"
    t = f"regexp_replace({t}, '{X.HASHTAG}', '\\1', 'g')"
    return f"trim(regexp_replace({t}, '{X.SPACE}+', ' ', 'g'))"


def _sql_emoji(expr: str) -> str:
    p = " + ".join(f"CAST(contains({expr}, '{cp}') AS INT)" for cp in X.POSITIVE_EMOJI.values())
    n = " + ".join(f"CAST(contains({expr}, '{cp}') AS INT)" for cp in X.NEGATIVE_EMOJI.values())
    return f"CASE WHEN ({p}) + ({n}) > 0 THEN (({p}) - ({n})) / (({p}) + ({n})) ELSE 0.0 END"


_SCORES_SQL = f"""
, {_sql_values('lex', N.OPINION_WORDS)}, {_sql_values('val', N.VALENCE_WORDS)},
  tx AS (SELECT seq, CASE WHEN title IS NOT NULL AND length(title) > 0 THEN title || ' ' || coalesce(content, '')
                          ELSE coalesce(content, '') END AS txt FROM posts),
  cl AS (SELECT seq, txt, lower({_sql_clean('txt')}) AS low FROM tx),
  tk AS (SELECT seq, unnest(CASE WHEN length(low) = 0 THEN []::VARCHAR[] ELSE string_split_regex(low, '{X.SPACE}+') END)
         AS tok FROM cl),
  ag AS (SELECT tk.seq, count(*) AS n, count(*) FILTER (WHERE lex.v > 0) AS pos, count(*) FILTER (WHERE lex.v < 0) AS neg,
                coalesce(sum(val.v), 0.0) AS s, count(val.v) AS m
         FROM tk LEFT JOIN lex ON lex.w = tk.tok LEFT JOIN val ON val.w = tk.tok GROUP BY tk.seq),
  parts AS (SELECT cl.seq,
     coalesce(ag.s, 0.0) / sqrt(coalesce(ag.s, 0.0) * coalesce(ag.s, 0.0) + {N.VALENCE_ALPHA}) AS vader,
     CASE WHEN coalesce(ag.m, 0) > 0 THEN ag.s / ag.m / 4.0 ELSE 0.0 END AS textblob,
     CASE WHEN coalesce(ag.n, 0) > 0 THEN (ag.pos - ag.neg) / ag.n ELSE 0.0 END AS lexicon,
     {_sql_emoji('cl.txt')} AS emoji,
     CAST(len(regexp_extract_all(cl.txt, '!')) - len(regexp_extract_all(cl.txt, '[?]')) AS DOUBLE) AS emphasis
   FROM cl LEFT JOIN ag USING (seq)),
  sc AS (SELECT *, (vader + textblob + lexicon) / 3 + 0.1 * emoji + 0.02 * emphasis AS combined FROM parts)
"""


@register("sentiment_scores", oracle(_SCORES_SQL + """
SELECT seq, CASE WHEN combined >= 0.05 THEN 'POSITIVE' WHEN combined <= -0.05 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
       round(abs(combined), 6) AS score, round(combined, 6) AS compound, round(vader, 6) AS vader,
       round(textblob, 6) AS textblob, round(lexicon, 6) AS lexicon, round(emoji, 6) AS emoji,
       round(emphasis, 6) AS emphasis
FROM sc
"""))
def q_sentiment_scores(spark, sf_dir):
    s = N.score_posts(posts(spark, sf_dir))
    d = F.col("sentiment.details")
    return rounded(s.select("seq", F.col("sentiment.label").alias("label"), F.col("sentiment.score").alias("score"),
                            F.col("sentiment.compound").alias("compound"),
                            *[d[k].alias(k) for k in ("vader", "textblob", "lexicon", "emoji", "emphasis")]))


_TABLE_LEXICON_SQL = """
, words AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark),
  lx AS (SELECT w, CASE WHEN length(w) % 2 = 0 THEN 1 ELSE -1 END AS p, CAST(length(w) % 9 - 4 AS DOUBLE) AS x FROM words WHERE length(w) >= 5)
"""


@register("lexicon_table_scores", oracle(_SCORES_SQL + _TABLE_LEXICON_SQL + f"""
, h AS (SELECT tk.seq, count(*) AS n, coalesce(sum(lx.p), 0) AS net, coalesce(sum(lx.x), 0.0) AS s, count(lx.x) AS m
        FROM tk LEFT JOIN lx ON lx.w = tk.tok GROUP BY tk.seq)
SELECT cl.seq, round(CASE WHEN coalesce(h.n, 0) > 0 THEN h.net / h.n ELSE 0.0 END, 6) AS lexicon,
       round(coalesce(h.s, 0.0) / sqrt(coalesce(h.s, 0.0) * coalesce(h.s, 0.0) + {N.VALENCE_ALPHA}), 6) AS vader,
       round(CASE WHEN coalesce(h.m, 0) > 0 THEN h.s / h.m / 4.0 ELSE 0.0 END, 6) AS textblob
FROM cl LEFT JOIN h USING (seq)
"""))
def q_lexicon_table_scores(spark, sf_dir):
    """N1/N6 with a lexicon table: the words of the benchmark passages, scored by their length."""
    from chorus.sources.fixture import read_table
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).distinct()
    n = F.length("word")
    lexicon = words.filter(n >= 5).select("word", F.when(n % 2 == 0, 1).otherwise(-1).alias("polarity"), (n % 9 - 4).cast("double").alias("valence"))
    return rounded(N.lexicon_table_scores(posts(spark, sf_dir), lexicon))


@register("scored_label_counts", oracle(_SCORES_SQL + """
SELECT count(*) FILTER (WHERE combined >= 0.05) AS positive, count(*) FILTER (WHERE combined <= -0.05) AS negative,
       count(*) FILTER (WHERE combined > -0.05 AND combined < 0.05) AS neutral
FROM sc
"""))
def q_scored_label_counts(spark, sf_dir):
    return N.label_counts(P.posts_flat(N.score_posts(posts(spark, sf_dir))))


@register("vader_labels", oracle(_SCORES_SQL + """
SELECT seq, CASE WHEN vader >= 0.05 THEN 'POSITIVE' WHEN vader <= -0.05 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
       round(abs(vader), 6) AS score FROM sc
"""))
def q_vader_labels(spark, sf_dir):
    s = N.vader_only(posts(spark, sf_dir))
    return rounded(s.select("seq", F.col("sentiment.label").alias("label"), F.col("sentiment.score").alias("score")))


@register("label_counts", oracle("""
SELECT count(*) FILTER (WHERE sentiment = 'POSITIVE') AS positive, count(*) FILTER (WHERE sentiment = 'NEGATIVE') AS negative,
       count(*) FILTER (WHERE sentiment = 'NEUTRAL') AS neutral FROM flat
"""))
def q_label_counts(spark, sf_dir):
    return N.label_counts(flat(spark, sf_dir))


@register("canonical_labels", oracle("""
, raw AS (SELECT seq, CASE seq % 4 WHEN 0 THEN sentiment WHEN 1 THEN ' ' || lower(sentiment) || ' '
                               WHEN 2 THEN left(sentiment, 3) ELSE left(sentiment, 2) END AS raw_label FROM posts)
SELECT seq, raw_label,
       CASE upper(trim(raw_label)) WHEN 'POS' THEN 'POSITIVE' WHEN 'NEG' THEN 'NEGATIVE' WHEN 'NE' THEN 'NEUTRAL'
            ELSE upper(trim(raw_label)) END AS label,
       CASE upper(trim(raw_label)) WHEN 'POSITIVE' THEN 1.0 WHEN 'POS' THEN 1.0 WHEN 'NEGATIVE' THEN -1.0
            WHEN 'NEG' THEN -1.0 ELSE 0.0 END::DOUBLE AS label_value
FROM raw
"""))
def q_canonical_labels(spark, sf_dir):
    from chorus.functions import columns as C
    f = fixture_flat_labels(spark, sf_dir)
    lab = C.canonical_label("raw_label")
    return f.select("seq", "raw_label", lab.alias("label"), C.label_value(lab).alias("label_value"))


def fixture_flat_labels(spark, sf_dir):
    from chorus.sources.fixture import fixture_flat
    f = fixture_flat(spark, sf_dir)
    s = F.col("sentiment")
    raw = (F.when(F.col("seq") % 4 == 0, s).when(F.col("seq") % 4 == 1, F.concat(F.lit(" "), F.lower(s), F.lit(" ")))
            .when(F.col("seq") % 4 == 2, F.substring(s, 1, 3)).otherwise(F.substring(s, 1, 2)))
    return f.select("seq", raw.alias("raw_label"))


# --------------------------------------------------------------------------- W: keywords

_SQL_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(
    {w for w in (*W.ENGLISH_STOPWORDS, *W.EXTRA_STOPWORDS) if len(w) >= W.MIN_WORD_LENGTH}))

_KEYWORDS_SQL = f"""
, kt AS (SELECT seq, sentiment, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            coalesce(title, '') || ' ' || coalesce(content, ''), '{X.HTTP_URL}', '', 'g'), '{X.MENTION}', '', 'g'),
            '{X.HASHTAG}', '\\1', 'g'), '{X.NOT_WORD_OR_SPACE}', ' ', 'g'), '{X.DIGITS}', '', 'g')) AS t FROM posts),
  kw AS (SELECT seq, sentiment, word FROM (SELECT seq, sentiment, unnest(string_split_regex(t, '{X.SPACE}+')) AS word FROM kt)
         WHERE length(word) >= 3 AND word NOT IN ({_SQL_STOP}))
"""


@register("word_frequencies", oracle(_KEYWORDS_SQL + """
SELECT word, count(*) AS count FROM kw GROUP BY word
HAVING count(*) >= CASE WHEN (SELECT count(*) FROM posts) > 20 THEN 2 ELSE 1 END
"""))
def q_word_frequencies(spark, sf_dir):
    return W.word_frequencies(posts(spark, sf_dir))


@register("word_frequencies_negative", oracle(_KEYWORDS_SQL + """
SELECT word, count(*) AS count FROM kw WHERE sentiment = 'NEGATIVE' GROUP BY word
HAVING count(*) >= CASE WHEN (SELECT count(*) FROM posts WHERE sentiment = 'NEGATIVE') > 20 THEN 2 ELSE 1 END
"""))
def q_word_frequencies_negative(spark, sf_dir):
    return W.word_frequencies(posts(spark, sf_dir), "NEGATIVE")


@register("word_frequencies_by_class", oracle(_KEYWORDS_SQL + """
, tg AS (SELECT DISTINCT w AS word, ['N', 'V', 'A', 'R', 'P'][length(w) % 5 + 1] AS tag
         FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark)),
sx AS (SELECT suffix, arg_min(tag, (-n, tag)) AS tag
       FROM (SELECT right(word, k) AS suffix, tag, count(*) AS n FROM tg, range(1, 5) r(k) WHERE length(word) > k GROUP BY ALL) GROUP BY suffix),
f AS (SELECT word, count(*) AS count FROM kw GROUP BY word
      HAVING count(*) >= CASE WHEN (SELECT count(*) FROM posts) > 20 THEN 2 ELSE 1 END),
g AS (SELECT f.word, arg_max(sx.tag, k) AS tag FROM f, range(1, 5) r(k) JOIN sx ON sx.suffix = right(f.word, k) WHERE length(f.word) > k GROUP BY f.word)
SELECT f.word, f.count FROM f LEFT JOIN tg ON tg.word = f.word LEFT JOIN g ON g.word = f.word
WHERE coalesce(tg.tag, g.tag, 'N') IN ('N', 'A', 'R')"""))
def q_word_frequencies_by_class(spark, sf_dir):
    """W1's word classes: a tag for each word of the benchmark texts, by length; other words by their endings."""
    from chorus.sources.fixture import read_table
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("word")).distinct()
    classes = F.array(*map(F.lit, "NVARP"))
    tags = words.select("word", F.element_at(classes, F.char_length("word") % 5 + 1).alias("tag"))
    return W.word_frequencies(posts(spark, sf_dir), tags=tags)


@register("top_words", oracle(_KEYWORDS_SQL + """
, f AS (SELECT word, count(*) AS count FROM kw GROUP BY word
        HAVING count(*) >= CASE WHEN (SELECT count(*) FROM posts) > 20 THEN 2 ELSE 1 END)
SELECT word, count FROM f ORDER BY count DESC, word LIMIT 100
"""))
def q_top_words(spark, sf_dir):
    return W.top_words(posts(spark, sf_dir))


# --------------------------------------------------------------------------- G: graphs

_MENTION_SQL = """
, me AS (SELECT author, mention1 AS mention, count(*) AS count,
                array_to_string(list_sort(list_distinct(list(CASE WHEN platform = 'reddit' AND length(subreddit) > 0
                                                                  THEN subreddit END))), '|') AS subreddits,
                min(seq) AS first_seq
         FROM posts WHERE mention1 IS NOT NULL GROUP BY author, mention1),
  mg AS (SELECT least(author, mention) AS src, greatest(author, mention) AS dst,
                arg_max(count, first_seq) AS weight, arg_max(subreddits, first_seq) AS subreddits
         FROM me WHERE count >= 2 GROUP BY 1, 2)
"""


@register("mention_edges", oracle(_MENTION_SQL + "SELECT author, mention, count, subreddits, first_seq FROM me"))
def q_mention_edges(spark, sf_dir):
    e = G.mention_edges(posts(spark, sf_dir))
    return e.select("author", "mention", "count", F.array_join("subreddits", "|").alias("subreddits"), "first_seq")


@register("mention_graph", oracle(_MENTION_SQL + "SELECT src, dst, weight, subreddits FROM mg"))
def q_mention_graph(spark, sf_dir):
    g = G.mention_graph(G.mention_edges(posts(spark, sf_dir)))
    return g.select("src", "dst", "weight", F.array_join("subreddits", "|").alias("subreddits"))


@register("degree_centrality", oracle(_MENTION_SQL + """
, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM mg UNION ALL SELECT dst FROM mg) GROUP BY node)
SELECT node, degree, round(CASE WHEN (SELECT count(*) FROM d) <= 1 THEN 1.0
                                ELSE degree / ((SELECT count(*) FROM d) - 1) END, 6) AS centrality FROM d
"""))
def q_degree_centrality(spark, sf_dir):
    return rounded(G.degree_centrality(G.mention_graph(G.mention_edges(posts(spark, sf_dir)))))


@register("node_tone", oracle(_MENTION_SQL + """
, n AS (SELECT DISTINCT node FROM (SELECT src AS node FROM mg UNION ALL SELECT dst FROM mg)),
  c AS (SELECT author AS node, count(*) FILTER (WHERE sentiment = 'POSITIVE') AS pos,
               count(*) FILTER (WHERE sentiment = 'NEGATIVE') AS neg, count(*) AS total
        FROM flat WHERE sentiment <> 'UNKNOWN' GROUP BY author)
SELECT n.node, coalesce(c.total, 0) AS scored_posts,
       CASE WHEN coalesce(c.total, 0) = 0 THEN 'gray' WHEN c.neg / c.total > 0.6 THEN 'red'
            WHEN c.pos / c.total > 0.6 THEN 'green' ELSE 'yellow' END AS tone
FROM n LEFT JOIN c USING (node)
"""))
def q_node_tone(spark, sf_dir):
    p = posts(spark, sf_dir)
    g = G.mention_graph(G.mention_edges(p))
    nodes = g.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return G.node_tone(nodes, P.posts_flat(p))


@register("subreddit_topic_edges", oracle("""
SELECT coalesce(subreddit, 'unknown') AS subreddit, query AS topic, count(*) AS weight FROM posts GROUP BY 1, 2
"""))
def q_subreddit_topic_edges(spark, sf_dir):
    return G.subreddit_topic_edges(posts(spark, sf_dir))


@register("triangular_network", oracle("""
, e AS (SELECT 'user' AS src_type, author AS src, 'subreddit' AS dst_type, subreddit AS dst FROM posts
          WHERE length(author) > 0 AND length(subreddit) > 0
        UNION ALL SELECT 'user', author, 'topic', query FROM posts WHERE length(author) > 0 AND length(query) > 0
        UNION ALL SELECT 'subreddit', subreddit, 'topic', query FROM posts WHERE length(subreddit) > 0 AND length(query) > 0)
SELECT src_type, src, dst_type, dst, count(*) AS weight FROM e GROUP BY ALL
"""))
def q_triangular_network(spark, sf_dir):
    return G.triangular_network(flat(spark, sf_dir))


@register("user_top_terms", oracle("""
, s AS (SELECT * FROM flat WHERE sentiment <> 'UNKNOWN'),
  act AS (SELECT author FROM s GROUP BY author HAVING count(*) >= 3),
  t AS (SELECT author, seq, 'topic' AS kind, query AS term FROM s
        UNION ALL SELECT author, seq, 'subreddit', subreddit FROM s),
  c AS (SELECT author, kind, term, count(*) AS count, min(seq) AS first_seq FROM t
        WHERE term IS NOT NULL AND length(term) > 0 GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY author, kind ORDER BY count DESC, first_seq) AS rank FROM c)
SELECT author, kind, rank, term, count FROM r WHERE rank <= 3 AND author IN (SELECT author FROM act)
"""))
def q_user_top_terms(spark, sf_dir):
    return G.user_top_terms(flat(spark, sf_dir))


# --------------------------------------------------------------------------- F: filters

@register("posts_in_range", oracle("""
SELECT seq, id, platform FROM posts WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'
"""))
def q_posts_in_range(spark, sf_dir):
    return FL.in_date_range(posts(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-12 12:00:00").select(
        "seq", "id", "platform")


@register("author_time_filter", oracle("""
SELECT author, CASE WHEN d <= 1 THEN 'day' WHEN d <= 7 THEN 'week' WHEN d <= 30 THEN 'month'
                    WHEN d <= 365 THEN 'year' ELSE 'all' END AS time_filter
FROM (SELECT author, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS d FROM posts GROUP BY author)
"""))
def q_author_time_filter(spark, sf_dir):
    span = posts(spark, sf_dir).groupBy("author").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return span.select("author", FL.time_filter_bucket(F.col("lo"), F.col("hi")).alias("time_filter"))


@register("limit_per_query", oracle("""
SELECT seq, query FROM posts QUALIFY row_number() OVER (PARTITION BY query ORDER BY ts DESC, platform, id) <= 100
"""))
def q_limit_per_query(spark, sf_dir):
    return FL.limit_per_query(posts(spark, sf_dir), 100).select("seq", "query")


@register("user_timeline", oracle("""
SELECT seq, CASE WHEN platform = 'reddit' THEN 'u/user7' ELSE '@user7' END AS query
FROM posts WHERE author = 'user7' AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'
ORDER BY ts DESC, seq LIMIT 50
"""))
def q_user_timeline(spark, sf_dir):
    return FL.user_timeline(posts(spark, sf_dir), "user7", "2024-01-01", "2024-01-31", limit=50).select("seq", "query")


_RAW_QUERIES_SQL = """
, rq AS (SELECT seq, CASE seq % 5 WHEN 0 THEN query WHEN 1 THEN '  ' || upper(query) || '   now '
                             WHEN 2 THEN substr(author, 1, 1) WHEN 3 THEN query || E'\\\\' || E'\\t' || author
                             ELSE repeat(query || ' ', 25) END AS raw FROM posts)
"""


def _raw_queries(spark, sf_dir):
    p = posts(spark, sf_dir)
    q, s = F.col("query"), F.col("seq") % 5
    raw = (F.when(s == 0, q).when(s == 1, F.concat(F.lit("  "), F.upper(q), F.lit("   now ")))
            .when(s == 2, F.substring("author", 1, 1)).when(s == 3, F.concat(q, F.lit("\\\t"), F.col("author")))
            .otherwise(F.repeat(F.concat(q, F.lit(" ")), 25)))
    return p.select("seq", raw.alias("raw"))


@register("distinct_queries", oracle(_RAW_QUERIES_SQL + f"""
, c AS (SELECT seq, trim(regexp_replace(raw, '{X.SPACE}+', ' ', 'g')) AS q FROM rq)
SELECT arg_min(q, seq) AS query, min(seq) AS pos FROM c WHERE length(q) > 0 GROUP BY lower(q)
"""))
def q_distinct_queries(spark, sf_dir):
    return FL.distinct_queries(_raw_queries(spark, sf_dir).withColumnRenamed("seq", "pos"), col="raw") \
        .withColumnRenamed("raw", "query")


@register("validate_queries", oracle(_RAW_QUERIES_SQL + """
, t AS (SELECT seq, trim(raw) AS q FROM rq), c AS (SELECT seq, q, substr(q, 1, 100) AS cut FROM t)
SELECT seq,
  CASE WHEN length(q) < 2 THEN NULL
       ELSE replace(replace(replace(replace(cut, E'\\\\', ''), E'\\n', ' '), E'\\r', ' '), E'\\t', ' ') END AS valid_query,
  CASE WHEN length(q) = 0 THEN NULL WHEN length(q) < 2 THEN 'Query too short (skipped): ''' || q || ''''
       WHEN length(q) > 100 THEN 'Query truncated: ''' || substr(q, 1, 50) || '...'''
       WHEN regexp_matches(cut, '[\\\\\\n\\r\\t]') THEN 'Special characters removed from: ''' || cut || ''''
       END AS warning
FROM c
"""))
def q_validate_queries(spark, sf_dir):
    v = FL.validate_queries(_raw_queries(spark, sf_dir), col="raw")
    return v.select("seq", "valid_query", "warning")


@register("dashboard_filter", oracle("""
SELECT seq FROM flat WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-15' AND score_m BETWEEN 0.2 AND 0.8
"""))
def q_dashboard_filter(spark, sf_dir):
    return FL.dashboard_filter(posts(spark, sf_dir), "2024-01-05", "2024-01-15", 0.2, 0.8).select("seq")


@register("negative_by_query", oracle("""
SELECT query, count(*) AS count FROM posts WHERE sentiment = 'NEGATIVE' GROUP BY query
"""))
def q_negative_by_query(spark, sf_dir):
    return FL.sentiment_filter(posts(spark, sf_dir), "NEGATIVE").groupBy("query").agg(F.count(F.lit(1)).alias("count"))


@register("scatter_sample", oracle("""
SELECT seq, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, CAST(coalesce(likes, 0) + coalesce(retweets, 0) AS DOUBLE)
       AS engagement, score_m AS sentiment_score, sentiment AS sentiment_label, author,
       substr(content, 1, 100) || '...' AS content_preview
FROM (SELECT * FROM flat ORDER BY seq LIMIT 1000) WHERE sentiment <> 'UNKNOWN' AND (SELECT count(*) FROM posts) >= 10
"""))
def q_scatter_sample(spark, sf_dir):
    return FL.scatter_sample(posts(spark, sf_dir))


# --------------------------------------------------------------------------- S: sources

def _raw_tweets(spark, sf_dir, blanks=False):
    """Landed tweet JSON lines, written by Spark from the twitter posts."""
    p = fixture_posts(spark, sf_dir, blanks=blanks).filter(F.col("platform") == "twitter")
    e = lambda k: F.try_element_at("engagement", F.lit(k)).cast("bigint")
    tweet = F.struct(
        F.col("id"), F.col("timestamp").alias("date"),
        F.struct(F.col("author").alias("username"), F.col("author_id").alias("id")).alias("user"),
        F.col("content").alias("rawContent"), e("likes").alias("likeCount"), e("retweets").alias("retweetCount"),
        e("replies").alias("replyCount"),
        F.transform("metadata.hashtags", lambda h: F.struct(h.alias("text"))).alias("hashtags"),
        F.transform("metadata.mentions", lambda m: F.struct(m.alias("username"))).alias("mentionedUsers"),
        F.when(F.col("seq") % 5 == 0, F.lit("123")).alias("inReplyToTweetId"))
    return p.select("seq", "query", F.to_json(tweet).alias("value"))


@register("ingest_tweets", oracle(f"""
SELECT seq, id, author, content_length, likes, retweets, replies, quotes, engagement_total, url, query,
       hashtags, mentions, is_reply
FROM (SELECT seq, id, author, CAST(length(content) AS BIGINT) AS content_length,
        CAST(likes AS DOUBLE) AS likes, CAST(retweets AS DOUBLE) AS retweets, CAST(replies AS DOUBLE) AS replies,
        0.0::DOUBLE AS quotes, CAST(likes + retweets + replies AS DOUBLE) AS engagement_total,
        'https://twitter.com/i/status/' || id AS url, query,
        array_to_string(CASE WHEN hashtag1 IS NOT NULL OR hashtag2 IS NOT NULL
                             THEN list_filter([hashtag1, hashtag2], lambda x: x IS NOT NULL)
                             ELSE regexp_extract_all(content, '{X.HASHTAG}', 1) END, '|') AS hashtags,
        array_to_string(CASE WHEN mention1 IS NOT NULL THEN [mention1]
                             ELSE regexp_extract_all(content, '@({X.WORD}+)', 1) END, '|') AS mentions,
        seq % 5 = 0 AS is_reply
      FROM posts WHERE platform = 'twitter')
"""))
def q_ingest_tweets(spark, sf_dir):
    from chorus.functions import columns as C
    from chorus.sources import ingest as I
    raw = _raw_tweets(spark, sf_dir)
    parsed = raw.select("seq", "query", F.from_json("value", I.TWEET_SCHEMA).alias("t")).select("seq", "query", "t.*")
    t = I.tweets_to_posts(parsed, "query", seq=F.col("seq"))
    e = lambda k: F.try_element_at("engagement", F.lit(k))
    return t.select("seq", "id", "author", F.char_length("content").cast("bigint").alias("content_length"),
                    e("likes").alias("likes"), e("retweets").alias("retweets"), e("replies").alias("replies"),
                    e("quotes").alias("quotes"), C.engagement_total().alias("engagement_total"), "url", "query",
                    F.array_join("metadata.hashtags", "|").alias("hashtags"),
                    F.array_join("metadata.mentions", "|").alias("mentions"),
                    F.col("metadata.is_reply").alias("is_reply"))


def _raw_submissions(spark, sf_dir, blanks=False):
    from chorus.functions import columns as C
    p = fixture_flat_reddit(spark, sf_dir, blanks)
    sub = F.struct(
        "id", "title", F.col("content").alias("selftext"),
        F.when(F.col("author") != "[deleted]", F.col("author")).alias("author"),
        F.concat(F.lit("t2_"), F.col("author_id")).alias("author_fullname"),
        F.concat(F.lit("/r/"), F.col("subreddit"), F.lit("/comments/"), F.col("id")).alias("permalink"),
        "subreddit", F.floor(C.micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "ts") / 1000000).cast("double")
        .alias("created_utc"),
        "score", "num_comments",
        F.when(F.col("seq") % 7 == 0, F.lit(0.0)).otherwise(F.col("upvote_ratio")).alias("upvote_ratio"),
        F.array_repeat(F.struct(F.lit("a").alias("id")), (F.col("seq") % 3).cast("int")).alias("all_awardings"))
    return p.select("seq", "query", sub.alias("s"))


def fixture_flat_reddit(spark, sf_dir, blanks=False):
    from chorus.sources.fixture import fixture_flat
    return fixture_flat(spark, sf_dir, blanks=blanks).filter(F.col("platform") == "reddit")


@register("ingest_submissions", oracle("""
SELECT seq, id, coalesce(CASE WHEN author <> '[deleted]' THEN author END, '[deleted]') AS author,
       't2_' || author_id AS author_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS timestamp,
       CAST(score AS DOUBLE) AS score,
       CAST(CASE WHEN r = 0 THEN score ELSE trunc(score * r) END AS DOUBLE) AS upvotes,
       CAST(CASE WHEN r = 0 THEN 0 ELSE trunc(score * (1 - r)) END AS DOUBLE) AS downvotes,
       CAST(num_comments AS DOUBLE) AS num_comments, r AS upvote_ratio,
       round(score + CASE WHEN r = 0 THEN score ELSE trunc(score * r) END + CASE WHEN r = 0 THEN 0 ELSE trunc(score * (1 - r)) END
             + num_comments + r, 6) AS engagement_total,
       'https://reddit.com/r/' || subreddit || '/comments/' || id AS url, CAST(seq % 3 AS BIGINT) AS awards
FROM (SELECT *, CASE WHEN seq % 7 = 0 THEN 0.0 ELSE upvote_ratio END AS r FROM posts WHERE platform = 'reddit')
"""))
def q_ingest_submissions(spark, sf_dir):
    from chorus.functions import columns as C
    from chorus.sources import ingest as I
    raw = _raw_submissions(spark, sf_dir)
    parsed = raw.select("seq", "query", F.from_json(F.to_json("s"), I.SUBMISSION_SCHEMA).alias("s")).select(
        "seq", "query", "s.*")
    t = I.submissions_to_posts(parsed, "query", seq=F.col("seq"))
    e = lambda k: F.try_element_at("engagement", F.lit(k))
    return rounded(t.select("seq", "id", "author", "author_id",
                            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                            *[e(k).alias(k) for k in ("score", "upvotes", "downvotes", "num_comments", "upvote_ratio")],
                            C.engagement_total().alias("engagement_total"), "url",
                            F.col("metadata.awards").alias("awards")))


@register("ingest_listing", oracle("""
SELECT seq, id, CAST(score AS DOUBLE) AS score, 0.0::DOUBLE AS upvotes, 0.0::DOUBLE AS downvotes,
       CAST(num_comments AS DOUBLE) AS num_comments, CASE WHEN seq % 7 = 0 THEN 0.0 ELSE upvote_ratio END AS upvote_ratio,
       subreddit, CAST(seq // 300 AS BIGINT) AS page
FROM posts WHERE platform = 'reddit'
"""))
def q_ingest_listing(spark, sf_dir):
    from chorus.sources import ingest as I
    raw = _raw_submissions(spark, sf_dir)
    page = (F.col("seq") / 300).cast("bigint")
    # one listing page per 100 consecutive reddit posts (seq step 3), as the API pages them
    pages = raw.groupBy(page.alias("page"), "query").agg(
        F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.struct(F.col("s.*"), F.col("seq").alias("seq_"))
                                                             .alias("data"))).alias("children")).alias("data")))
        .alias("value"))
    # the listing schema, with the input order carried inside each child
    child = T.StructType(I.SUBMISSION_SCHEMA.fields + [T.StructField("seq_", T.LongType())])
    listing = T.StructType([T.StructField("data", T.StructType([
        T.StructField("children", T.ArrayType(T.StructType([T.StructField("data", child)])))]))])
    parsed = pages.select("page", "query", F.from_json("value", listing).alias("l")).select("page", "query", "l.data")
    t = I.listing_to_posts(parsed, "query", seq=F.col("seq_"))
    e = lambda k: F.try_element_at("engagement", F.lit(k))
    return t.select("seq", "id", *[e(k).alias(k) for k in ("score", "upvotes", "downvotes", "num_comments", "upvote_ratio")],
                    F.col("metadata.subreddit").alias("subreddit"), (F.col("seq") / 300).cast("bigint").alias("page"))


@register("ingest_comments", oracle("""
SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id,
       CASE WHEN role = 'system' THEN '[deleted]' ELSE role END AS author, md5(text) AS body_md5, turn AS score,
       strftime(TIMESTAMP '2024-01-01' + to_seconds(turn * 60), '%Y-%m-%d %H:%M:%S') AS created_utc,
       role = 'user' AS is_submitter, 't3_' || CAST(conv_id AS VARCHAR) AS parent_id,
       'https://reddit.com/c/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS permalink
FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5
"""))
def q_ingest_comments(spark, sf_dir):
    from chorus.sources import ingest as I
    from chorus.sources.fixture import read_table
    conv = read_table(spark, sf_dir, "conversations")
    cid = F.col("conv_id").cast("string")
    raw = conv.select(
        F.concat(cid, F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.when(F.col("role") != "system", F.col("role")).alias("author"), F.col("text").alias("body"),
        F.col("turn").alias("score"),
        (F.lit(1704067200) + F.col("turn") * 60).cast("double").alias("created_utc"),
        (F.col("role") == "user").alias("is_submitter"), F.concat(F.lit("t3_"), cid).alias("parent_id"),
        F.concat(F.lit("/c/"), cid, F.lit("/"), F.col("turn").cast("string")).alias("permalink"),
        cid.alias("submission_id"), F.col("turn").alias("position"))
    c = I.comments_to_rows(raw, limit=5)
    return c.select("id", "author", F.md5("body").alias("body_md5"), "score",
                    F.date_format("created_utc", "yyyy-MM-dd HH:mm:ss").alias("created_utc"),
                    "is_submitter", "parent_id", "permalink")


@register("collection_stats", oracle("""
SELECT platform, count(*) AS posts, count(DISTINCT query) AS queries,
       round(count(*) / count(DISTINCT query), 6) AS posts_per_query FROM posts GROUP BY platform
"""))
def q_collection_stats(spark, sf_dir):
    from chorus.sources import ingest as I
    p = posts(spark, sf_dir)
    both = I.union_sources(p.filter(F.col("platform") == "twitter"), p.filter(F.col("platform") == "reddit"))
    return rounded(I.collection_stats(both))


@register("collection_by_query", oracle("SELECT platform, query, count(*) AS posts FROM posts GROUP BY ALL"))
def q_collection_by_query(spark, sf_dir):
    from chorus.sources import ingest as I
    return I.collection_by_query(posts(spark, sf_dir))


@register("coerce_posts", oracle("""
SELECT seq, CASE WHEN seq % 11 = 0 THEN 'batch' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS timestamp,
       CAST(CASE WHEN seq % 13 = 0 THEN 0 ELSE 1 END AS BIGINT) AS engagement_keys_nonzero
FROM posts
"""))
def q_coerce_posts(spark, sf_dir):
    """Posts landed with ISO timestamp text (some unparseable) and some without engagement."""
    from chorus.schema import coerce_posts
    p = posts(spark, sf_dir)
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    loose = p.select("seq", "id", "platform", "author", "content",
                     F.when(F.col("seq") % 11 == 0, F.lit("not a date")).otherwise(iso).alias("timestamp"),
                     F.when(F.col("seq") % 13 == 0, F.lit(None)).otherwise(F.col("engagement")).alias("engagement"),
                     "query", "metadata")
    batch_ts = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")  # text → NTZ: no zone involved
    c = coerce_posts(loose, batch_ts=batch_ts)
    return c.select("seq", F.when(F.col("timestamp") == batch_ts, F.lit("batch"))
                    .otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("timestamp"),
                    (F.size("engagement") > 0).cast("bigint").alias("engagement_keys_nonzero"))


@register("dedup_incremental", blank_oracle(_DEDUP_SQL + "SELECT seq, kept, dup_type FROM tagged"))
def q_dedup_incremental(spark, sf_dir):
    """Two successive batches (first and second half of the month) with carried state
    give the same result as one pass over all posts."""
    p = blanked(spark, sf_dir)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    seen0 = spark.createDataFrame([], "id_key string, hash_key string")
    t1, seen1 = D.dedup_incremental(p.filter(F.col("timestamp") < cut), seen0)
    seen1 = seen1.checkpoint(eager=True)
    t2, _ = D.dedup_incremental(p.filter(F.col("timestamp") >= cut), seen1)
    return t1.select("seq", "kept", "dup_type").unionByName(t2.select("seq", "kept", "dup_type"))


@register("dedup_incremental_repeat", blank_oracle(_DEDUP_SQL + """
SELECT k.seq, FALSE AS kept, CASE WHEN EXISTS (SELECT 1 FROM t a WHERE a.kept AND a.id_key = k.id_key) THEN 'exact_id' ELSE 'content' END
       AS dup_type FROM k"""))
def q_dedup_incremental_repeat(spark, sf_dir):
    """A second batch that repeats the first one whole keeps nothing."""
    p = D.keyed_posts(blanked(spark, sf_dir))
    _, seen = D.dedup_incremental(p, spark.createDataFrame([], "id_key string, hash_key string"))
    again, _ = D.dedup_incremental(p, seen.checkpoint(eager=True))
    return again.select("seq", "kept", "dup_type")


@register("pipeline_from_sources", blank_oracle(_DEDUP_SQL.replace("FROM posts)", """FROM (
    SELECT * REPLACE (row_number() OVER (ORDER BY CASE platform WHEN 'twitter' THEN 0 ELSE 1 END, seq) AS seq) FROM posts))""", 1) + """
SELECT split_part(k.id_key, ':', 1) AS platform, split_part(k.id_key, ':', 2) AS id, k.hash_key, t.kept,
       CASE WHEN t.kept THEN NULL WHEN t.id_seq < t.seq THEN 'exact_id' ELSE 'content' END AS dup_type
FROM t JOIN k USING (seq)"""))
def q_pipeline_from_sources(spark, sf_dir):
    """Landed tweet and submission files, read, united in source order, de-duplicated."""
    import uuid

    from chorus.session import ensure_checkpoint_dir, shuffles_released
    from chorus.sources import ingest as I
    land = f"{ensure_checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    tweets = _raw_tweets(spark, sf_dir, blanks=True)
    subs = _raw_submissions(spark, sf_dir, blanks=True)
    with shuffles_released(spark):  # the ordered lines are on disk once, in their files
        tweets.orderBy("seq").select("value").write.option("compression", "gzip").text(f"{land}/tweets")
        subs.orderBy("seq").select(F.to_json("s").alias("value")).write.option("compression", "gzip").text(f"{land}/submissions")
    united = I.union_sources(I.read_tweets(spark, f"{land}/tweets", "landed"), I.read_submissions(spark, f"{land}/submissions", "landed"))
    flags = D.dedup_flags(united)
    return flags.select(F.substring_index("id_key", ":", 1).alias("platform"), F.expr("substring(id_key, instr(id_key, ':') + 1)").alias("id"),
                        "hash_key", "kept", "dup_type")


@register("limit_per_subreddit", oracle("""
, r AS (SELECT *, coalesce(subreddit, '') AS sub, row_number() OVER (PARTITION BY query, coalesce(subreddit, '') ORDER BY ts DESC, id, seq) AS rk FROM posts),
  n AS (SELECT query, sub, count(*) AS n FROM r WHERE rk <= 5 GROUP BY ALL),
  b AS (SELECT *, sum(n) OVER (PARTITION BY query ORDER BY sub) - n AS before FROM n)
SELECT r.seq FROM r JOIN b USING (query, sub) WHERE rk <= 5 AND before < 40"""))
def q_limit_per_subreddit(spark, sf_dir):
    return FL.limit_per_subreddit(posts(spark, sf_dir), 5, total=40).select("seq")


# --------------------------------------------------------------------------- E: exports

@register("export_posts", oracle("""
SELECT id, platform, author, author_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
       CAST(ts AS DATE) AS date, CAST(extract(hour FROM ts) AS BIGINT) AS hour, query,
       'https://' || platform || '.example/' || id AS url,
       md5(CASE WHEN length(trim(content)) <= 500 THEN trim(content) ELSE substr(trim(content), 1, 497) || '...' END) AS content_md5,
       CAST(length(content) AS BIGINT) AS content_length,
       CASE WHEN length(title) > 0 THEN title ELSE '' END AS title,
       CASE WHEN sentiment = 'UNKNOWN' THEN '' ELSE sentiment END AS sentiment, score_m AS sentiment_score,
       CASE WHEN sentiment = 'UNKNOWN' THEN '' ELSE 'fixture' END AS sentiment_method,
       likes_m AS likes, shares_m AS shares, replies_m AS replies, round(engagement_total, 6) AS engagement_total,
       hashtag_count, mention_count, false AS has_media
FROM flat
"""))
def q_export_posts(spark, sf_dir):
    from chorus.plans import export as E
    e = E.export_posts(posts(spark, sf_dir))
    e = e.withColumn("content_md5", F.md5("content")).drop("content")
    return rounded(e)


@register("export_daily_statistics", oracle("""
SELECT date, count(*) AS total_posts, count(*) FILTER (WHERE sentiment = 'POSITIVE') AS positive,
  count(*) FILTER (WHERE sentiment = 'NEGATIVE') AS negative, count(*) FILTER (WHERE sentiment = 'NEUTRAL') AS neutral,
  round((count_if(sentiment = 'POSITIVE') - count_if(sentiment = 'NEGATIVE')) / count(*), 6) AS sentiment_ratio,
  round(count_if(sentiment = 'POSITIVE') / count(*), 6) AS positive_ratio,
  round(avg(sentiment_value), 6) AS avg_sentiment_score, CAST(trunc(sum(engagement_total)) AS BIGINT) AS total_engagement,
  round(avg(engagement_total), 6) AS avg_engagement, count(DISTINCT author) AS unique_authors
FROM flat GROUP BY date
"""))
def q_export_daily_statistics(spark, sf_dir):
    from chorus.plans import export as E
    return rounded(E.export_daily_statistics(flat(spark, sf_dir)))


@register("export_summary_statistics", oracle("""
, b AS (SELECT count(*) AS n, count(DISTINCT author) AS authors, min(ts) AS lo, max(ts) AS hi,
               sum(likes_m) AS tl, sum(shares_m) AS ts_, avg(engagement_total) AS ae, max(engagement_total) AS me FROM flat),
  c AS (SELECT sentiment, count(*) AS n FROM flat GROUP BY sentiment)
SELECT 'total_posts' AS metric, CAST(n AS DOUBLE) AS value, 'general' AS category FROM b
UNION ALL SELECT 'unique_authors', CAST(authors AS DOUBLE), 'general' FROM b
UNION ALL SELECT 'date_range_days', CAST(floor((epoch_us(hi) - epoch_us(lo)) / 86400000000) + 1 AS DOUBLE), 'general' FROM b
UNION ALL SELECT 'sentiment_' || lower(sentiment), CAST(n AS DOUBLE), 'sentiment' FROM c
UNION ALL SELECT 'sentiment_ratio', round((sum(n) FILTER (WHERE sentiment = 'POSITIVE') - sum(n) FILTER (WHERE sentiment = 'NEGATIVE'))
                                          / sum(n), 6), 'sentiment' FROM c
UNION ALL SELECT 'total_likes', floor(tl), 'engagement' FROM b
UNION ALL SELECT 'total_shares', floor(ts_), 'engagement' FROM b
UNION ALL SELECT 'avg_engagement', round(ae, 6), 'engagement' FROM b
UNION ALL SELECT 'max_engagement', floor(me), 'engagement' FROM b
"""))
def q_export_summary_statistics(spark, sf_dir):
    from chorus.plans import export as E
    return rounded(E.export_summary_statistics(flat(spark, sf_dir)))


@register("hourly_activity", oracle("""
, h AS (SELECT unnest(range(24)) AS hour), c AS (SELECT hour, count(*) AS n FROM flat GROUP BY hour)
SELECT h.hour, coalesce(c.n, 0) AS count FROM h LEFT JOIN c USING (hour)
"""))
def q_hourly_activity(spark, sf_dir):
    from chorus.plans import export as E
    return E.hourly_activity(flat(spark, sf_dir))


@register("report_header", oracle("""
, t AS (SELECT count(*) AS n, count(DISTINCT author) AS a, min(ts) AS lo, max(ts) AS hi FROM flat)
SELECT format('{:,}', n) AS total_posts, format('{:,}', a) AS unique_authors,
       CASE WHEN CAST(lo AS DATE) = CAST(hi AS DATE) THEN strftime(lo, '%B %d, %Y')
            WHEN month(lo) = month(hi) AND year(lo) = year(hi) THEN strftime(lo, '%B %d') || ' - ' || strftime(hi, '%d, %Y')
            WHEN year(lo) = year(hi) THEN strftime(lo, '%B %d') || ' - ' || strftime(hi, '%B %d, %Y')
            ELSE strftime(lo, '%B %d, %Y') || ' - ' || strftime(hi, '%B %d, %Y') END AS date_range
FROM t
"""))
def q_report_header(spark, sf_dir):
    from chorus.plans import export as E
    return E.report_header(flat(spark, sf_dir))


@register("dashboard_rows", oracle("""
SELECT author, subreddit, query AS topic, CASE WHEN sentiment <> 'UNKNOWN' THEN sentiment END AS sentiment,
       CASE WHEN sentiment <> 'UNKNOWN' THEN sentiment_score END AS score, title, md5(content) AS content_md5,
       'https://' || platform || '.example/' || id AS url, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp
FROM posts
"""))
def q_dashboard_rows(spark, sf_dir):
    from chorus.plans import export as E
    d = E.dashboard_rows(posts(spark, sf_dir))
    return rounded(d.select("author", "subreddit", "topic", "sentiment", "score", "title",
                            F.md5("content").alias("content_md5"), "url",
                            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp")))


def _sub(name: str) -> str:
    return f"({ORACLES[name]})"


@register("summary_document", blank_oracle(_DEDUP_SQL + f"""
, c AS (SELECT count(*) AS n, count(DISTINCT author) AS authors, sum(engagement_total) AS es, avg(engagement_total) AS ea,
               count_if(sentiment = 'POSITIVE') AS p, count_if(sentiment = 'NEGATIVE') AS g, count_if(sentiment = 'NEUTRAL') AS u,
               count_if(sentiment = 'UNKNOWN') AS x FROM flat)
SELECT c.n AS total_posts, c.authors AS unique_authors, CAST(p AS BIGINT) AS positive, CAST(g AS BIGINT) AS negative,
       CAST(u AS BIGINT) AS neutral, CAST(x AS BIGINT) AS unknown, round(p / c.n * 100, 6) AS positive_percent,
       round(g / c.n * 100, 6) AS negative_percent, round(u / c.n * 100, 6) AS neutral_percent, round(x / c.n * 100, 6) AS unknown_percent,
       CAST(trunc(es) AS BIGINT) AS total_engagement, round(ea, 6) AS avg_engagement,
       (SELECT days FROM {_sub('date_range')}) AS date_range_days,
       (SELECT sentiment_ratio FROM {_sub('sentiment_summary')}) AS sentiment_ratio,
       (SELECT dominant_sentiment FROM {_sub('sentiment_summary')}) AS dominant_sentiment,
       (SELECT count(*) FROM {_sub('viral_posts')}) AS viral_posts_count,
       (SELECT overall_trend FROM {_sub('trend_summary').replace("WHERE NOT true OR", "WHERE true OR")}) AS overall_trend,
       (SELECT trend_strength FROM {_sub('trend_summary').replace("WHERE NOT true OR", "WHERE true OR")}) AS trend_strength,
       (SELECT overall FROM {_sub('volatility').replace("WHERE NOT true OR", "WHERE true OR")}) AS volatility,
       (SELECT count(*) FROM {_sub('anomalies').replace("WHERE NOT true OR", "WHERE true OR")}) AS anomalies_count,
       (SELECT count(*) FROM {_sub('negative_users')}) AS negative_users_count,
       (SELECT string_agg(author || ':' || CAST(post_count AS VARCHAR), '|' ORDER BY negative_ratio DESC, author)
        FROM (SELECT * FROM {_sub('negative_users')} ORDER BY negative_ratio DESC, author LIMIT 3)) AS negative_users_top_3,
       (SELECT count(*) FROM tagged) AS dedup_total, (SELECT count(*) FROM tagged WHERE kept) AS dedup_unique,
       (SELECT count(*) FROM tagged WHERE NOT kept) AS dedup_removed
FROM c
"""))
def q_summary_document(spark, sf_dir):
    """The summary document, one column per leaf."""
    from chorus.plans import export as E
    return rounded(E.summary_document(flat(spark, sf_dir), D.dedup_flags(blanked(spark, sf_dir))))


@register("export_negative_users", f"SELECT * FROM {_sub('negative_users')}")
def q_export_negative_users(spark, sf_dir):
    from chorus.plans import export as E
    return rounded(E.export_negative_users(flat(spark, sf_dir)))


@register("export_viral_posts", f"SELECT * FROM {_sub('viral_posts')}")
def q_export_viral_posts(spark, sf_dir):
    from chorus.plans import export as E
    p = posts(spark, sf_dir)
    return rounded(E.export_viral_posts(P.posts_flat(p), p))


@register("export_hashtags", f"SELECT term AS hashtag, count FROM {_sub('top_hashtags')}")
def q_export_hashtags(spark, sf_dir):
    from chorus.plans import export as E
    return E.export_hashtags(posts(spark, sf_dir))


@register("export_anomalies", f"""
SELECT date, type, z_score, severity, post_count, sentiment_value FROM {_sub('anomalies')}""")
def q_export_anomalies(spark, sf_dir):
    from chorus.plans import export as E
    return rounded(E.export_anomalies(gapped(spark, sf_dir)))


@register("report_negative_users", f"SELECT * FROM {_sub('negative_users')} ORDER BY negative_ratio DESC, author LIMIT 20")
def q_report_negative_users(spark, sf_dir):
    from chorus.plans import export as E
    return rounded(E.report_cuts({"negative_users": A.negative_users(flat(spark, sf_dir))})["negative_users"])


@register("report_viral_posts", f"SELECT * FROM {_sub('viral_posts')} ORDER BY engagement DESC, id LIMIT 10")
def q_report_viral_posts(spark, sf_dir):
    from chorus.plans import export as E
    p = posts(spark, sf_dir)
    return rounded(E.report_cuts({"viral_posts": A.viral_posts(P.posts_flat(p), p)})["viral_posts"])


@register("chart_sentiment_timeline", gap_oracle("""
SELECT date, count_if(sentiment = 'POSITIVE')::BIGINT AS positive, count_if(sentiment = 'NEGATIVE')::BIGINT AS negative,
       count_if(sentiment = 'NEUTRAL')::BIGINT AS neutral, CAST(trunc(sum(engagement_total)) AS BIGINT) AS total_engagement,
       round((count_if(sentiment = 'POSITIVE') - count_if(sentiment = 'NEGATIVE')) / count(*), 6) AS sentiment_ratio
FROM flat GROUP BY date"""))
def q_chart_sentiment_timeline(spark, sf_dir):
    from chorus.plans import export as E
    f = gapped(spark, sf_dir)
    return rounded(E.chart_tables(f, posts(spark, sf_dir))["sentiment_timeline"])


@register("network_nodes", oracle("""
SELECT DISTINCT type, id FROM (
  SELECT 'user' AS type, author AS id FROM posts WHERE length(author) > 0 AND (length(subreddit) > 0 OR length(query) > 0)
  UNION ALL SELECT 'subreddit', subreddit FROM posts WHERE length(subreddit) > 0 AND (length(author) > 0 OR length(query) > 0)
  UNION ALL SELECT 'topic', query FROM posts WHERE length(query) > 0 AND (length(author) > 0 OR length(subreddit) > 0))
"""))
def q_network_nodes(spark, sf_dir):
    p = posts(spark, sf_dir).select("author", "metadata", F.lit("").alias("query"), F.col("query").alias("topic"))
    return G.network_nodes(G.triangular_network(p))


@register("user_nodes", oracle("""
, s AS (SELECT * FROM flat WHERE sentiment <> 'UNKNOWN'),
  u AS (SELECT author, count(*) AS n, count_if(sentiment = 'POSITIVE') AS p, count_if(sentiment = 'NEGATIVE') AS g,
               count_if(sentiment = 'NEUTRAL') AS z, sum(engagement_total) AS e, count(DISTINCT query) AS nt, count(DISTINCT subreddit) AS ns
        FROM s GROUP BY author HAVING count(*) >= 3),
  t AS (SELECT author, query AS term, 'topic' AS kind, count(*) AS n, min(seq) AS f FROM s WHERE length(query) > 0 GROUP BY ALL
        UNION ALL SELECT author, subreddit, 'subreddit', count(*), min(seq) FROM s WHERE length(subreddit) > 0 GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY author, kind ORDER BY n DESC, f) AS rk FROM t),
  a AS (SELECT author, string_agg(term, '|' ORDER BY rk) FILTER (WHERE kind = 'topic') AS tt,
               string_agg(term, '|' ORDER BY rk) FILTER (WHERE kind = 'subreddit') AS ts FROM r WHERE rk <= 3 GROUP BY author)
SELECT u.author, n AS post_count, CAST(p AS BIGINT) AS positive, CAST(g AS BIGINT) AS negative, CAST(z AS BIGINT) AS neutral,
       round(e, 6) AS total_engagement, round(e / n, 6) AS avg_engagement, round((p - g) / n, 6) AS sentiment_score,
       round(p / n, 6) AS positivity_ratio, round(g / n, 6) AS negativity_ratio,
       CASE WHEN greatest(p, g, z) / n >= 0.7 THEN (CASE WHEN p >= g AND p >= z THEN 'POSITIVE' WHEN g >= z THEN 'NEGATIVE' ELSE 'NEUTRAL' END)
            WHEN greatest(p, g, z) / n >= 0.4 THEN 'MIXED' ELSE 'NEUTRAL' END AS user_type,
       nt AS n_topics, ns AS n_subreddits, coalesce(tt, '') AS top_topics, coalesce(ts, '') AS top_subreddits
FROM u LEFT JOIN a USING (author)
"""))
def q_user_nodes(spark, sf_dir):
    return rounded(G.user_nodes(flat(spark, sf_dir)))


@register("content_cut", oracle("""
SELECT seq, md5(CASE WHEN length(content) <= 100 THEN content ELSE substr(content, 1, 97) || '...' END) AS cut_md5 FROM posts
"""))
def q_content_cut(spark, sf_dir):
    from chorus.functions import columns as C
    return posts(spark, sf_dir).select("seq", F.md5(C.truncate_suffix("content", 100)).alias("cut_md5"))


@register("percent_labels", oracle("""
, c AS (SELECT sentiment, count(*) AS n FROM flat GROUP BY sentiment)
SELECT sentiment, format('{:.1f}%', 100 * n / sum(n) OVER ()) AS share FROM c
"""))
def q_percent_labels(spark, sf_dir):
    from chorus.functions import columns as C
    d = A.sentiment_distribution(flat(spark, sf_dir))
    return d.select("sentiment", C.format_percent("percentage").alias("share"))


@register("mention_pair_similarity", oracle(_MENTION_SQL + """
, s AS (SELECT * FROM flat WHERE sentiment <> 'UNKNOWN'),
  pr AS (SELECT author, (count(*) FILTER (WHERE sentiment = 'POSITIVE') - count(*) FILTER (WHERE sentiment = 'NEGATIVE'))
                         / count(*) AS x,
                list_sort(list_distinct(list(CASE WHEN length(query) > 0 THEN query END))) AS t,
                list_sort(list_distinct(list(CASE WHEN length(subreddit) > 0 THEN subreddit END))) AS sb
         FROM s GROUP BY author HAVING count(*) >= 3),
  j AS (SELECT mg.src, mg.dst, a.t AS t1, b.t AS t2, a.sb AS s1, b.sb AS s2, a.x AS x1, b.x AS x2
        FROM mg JOIN pr a ON a.author = mg.src JOIN pr b ON b.author = mg.dst),
  w AS (SELECT src, dst,
          CASE WHEN len(list_distinct(list_concat(t1, t2))) > 0
               THEN len(list_intersect(t1, t2)) / len(list_distinct(list_concat(t1, t2))) ELSE 0.0 END AS jt,
          CASE WHEN len(list_distinct(list_concat(s1, s2))) > 0
               THEN len(list_intersect(s1, s2)) / len(list_distinct(list_concat(s1, s2))) ELSE 0.0 END AS js,
          1 - abs(x1 - x2) AS sim, len(list_intersect(t1, t2)) AS st, len(list_intersect(s1, s2)) AS ss FROM j)
SELECT src, dst, round((jt + js + sim) / 3, 6) AS weight, round(jt, 6) AS topic_overlap, round(js, 6) AS subreddit_overlap,
       round(sim, 6) AS sentiment_similarity, CAST(st AS INTEGER) AS shared_topics, CAST(ss AS INTEGER) AS shared_subreddits
FROM w WHERE (st > 0 OR ss > 0) AND (jt + js + sim) / 3 > 0.3
"""))
def q_mention_pair_similarity(spark, sf_dir):
    p = posts(spark, sf_dir)
    f = P.posts_flat(p)
    pairs = G.mention_graph(G.mention_edges(p))
    return rounded(G.pair_similarity(G.user_profiles(f), pairs))


@register("user_profiles", oracle("""
, s AS (SELECT * FROM flat WHERE sentiment <> 'UNKNOWN')
SELECT author, round((count(*) FILTER (WHERE sentiment = 'POSITIVE') - count(*) FILTER (WHERE sentiment = 'NEGATIVE'))
                     / count(*), 6) AS sentiment_score,
       array_to_string(list_sort(list_distinct(list(CASE WHEN length(query) > 0 THEN query END))), '|') AS topics,
       array_to_string(list_sort(list_distinct(list(CASE WHEN length(subreddit) > 0 THEN subreddit END))), '|') AS subreddits
FROM s GROUP BY author HAVING count(*) >= 3
"""))
def q_user_profiles(spark, sf_dir):
    u = G.user_profiles(flat(spark, sf_dir))
    return rounded(u.select("author", "sentiment_score", F.array_join("topics", "|").alias("topics"),
                            F.array_join("subreddits", "|").alias("subreddits")))


# --------------------------------------------------------------------------- per-key series (by=[...])

@register("daily_sentiment_by_platform", gap_oracle("""
SELECT platform, date,
  count(*) FILTER (WHERE sentiment = 'POSITIVE') AS positive,
  count(*) FILTER (WHERE sentiment = 'NEGATIVE') AS negative,
  count(*) FILTER (WHERE sentiment = 'NEUTRAL') AS neutral,
  count(*) AS total,
  round((count(*) FILTER (WHERE sentiment = 'POSITIVE') - count(*) FILTER (WHERE sentiment = 'NEGATIVE')) / count(*), 6)
    AS sentiment_ratio,
  round(count(*) FILTER (WHERE sentiment = 'POSITIVE') / count(*), 6) AS positive_ratio,
  round(avg(sentiment_value), 6) AS avg_sentiment,
  round(coalesce(stddev_samp(sentiment_value), 0.0), 6) AS sentiment_std,
  CAST(trunc(sum(engagement_total)) AS BIGINT) AS total_engagement,
  round(avg(engagement_total), 6) AS avg_engagement,
  CAST(trunc(max(engagement_total)) AS BIGINT) AS max_engagement,
  count(DISTINCT author) AS unique_authors,
  round(count(*) / count(DISTINCT author), 6) AS posts_per_author
FROM flat GROUP BY platform, date
"""))
def q_daily_sentiment_by_platform(spark, sf_dir):
    return rounded(S.daily_sentiment(gapped(spark, sf_dir), by=["platform"]))


@register("daily_trend_by_query", gap_oracle("""
, b AS (SELECT query, date_trunc('day', ts) AS bucket, avg(sentiment_value) AS v, count(*) AS n FROM flat GROUP BY 1, 2),
  r AS (SELECT query, min(bucket) AS lo, max(bucket) AS hi, sum(n) AS n_posts FROM b GROUP BY query),
  g0 AS (SELECT query, n_posts, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS bucket FROM r),
  g AS (SELECT g0.query, g0.bucket, g0.n_posts, b.v,
               row_number() OVER (PARTITION BY g0.query ORDER BY g0.bucket) - 1 AS idx,
               count(*) OVER (PARTITION BY g0.query) AS n_buckets
        FROM g0 LEFT JOIN b ON b.query = g0.query AND b.bucket = g0.bucket)
SELECT query, strftime(bucket, '%Y-%m-%d') AS date, round(v, 6) AS sentiment_value,
  round(avg(v) OVER (PARTITION BY query ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ma_3,
  round(avg(v) OVER (PARTITION BY query ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma_7
FROM g WHERE n_posts >= 3 AND n_buckets >= 2
"""))
def q_daily_trend_by_query(spark, sf_dir):
    return rounded(S.daily_trend(gapped(spark, sf_dir), by=["query"]))


@register("anomalies_by_query", gap_oracle("""
, d AS (SELECT query, CAST(ts AS DATE) AS day, avg(sentiment_value) AS v, count(*) AS post_count,
               sum(engagement_total) AS es FROM flat GROUP BY 1, 2),
  s AS (SELECT *, avg(v) OVER (PARTITION BY query) AS mu, stddev_samp(v) OVER (PARTITION BY query) AS sd,
               sum(post_count) OVER (PARTITION BY query) AS n FROM d),
  z AS (SELECT *, (v - mu) / sd AS z FROM s WHERE n >= 6 AND sd <> 0)
SELECT query, strftime(day, '%Y-%m-%d') AS date, round(v, 6) AS sentiment_value, round(z, 6) AS z_score,
       CASE WHEN z > 0 THEN 'positive_spike' ELSE 'negative_spike' END AS type,
       post_count, CAST(trunc(es) AS BIGINT) AS total_engagement,
       CASE WHEN abs(z) > 3 THEN 'high' ELSE 'medium' END AS severity
FROM z WHERE abs(z) > 2.0
"""))
def q_anomalies_by_query(spark, sf_dir):
    return rounded(S.anomalies(gapped(spark, sf_dir), by=["query"]))


@register("trend_summary_by_query", gap_oracle("""
, b AS (SELECT query, date_trunc('day', ts) AS bucket, avg(sentiment_value) AS v, count(*) AS n FROM flat GROUP BY 1, 2),
  rg AS (SELECT query, min(bucket) AS lo, max(bucket) AS hi, sum(n) AS n_posts FROM b GROUP BY query),
  g0 AS (SELECT query, n_posts, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS bucket FROM rg),
  g AS (SELECT g0.query, g0.bucket, g0.n_posts, b.v,
               row_number() OVER (PARTITION BY g0.query ORDER BY g0.bucket) - 1 AS idx,
               count(*) OVER (PARTITION BY g0.query) AS n_buckets
        FROM g0 LEFT JOIN b ON b.query = g0.query AND b.bucket = g0.bucket),
  l AS (SELECT *, lag(v, 1) OVER w AS v_1, lag(v, 2) OVER w AS v_2, lag(v, 3) OVER w AS v_3,
               lag(v, 6) OVER w AS v_6, lag(v, 7) OVER w AS v_7, v - lag(v, 1) OVER w AS diff
        FROM g WINDOW w AS (PARTITION BY query ORDER BY idx)),
  r AS (SELECT *,
    avg(greatest(diff, 0.0)) OVER w14 AS avg_gain, avg(greatest(-diff, 0.0)) OVER w14 AS avg_loss,
    count(diff) OVER w14 AS n_diff14,
    count(*) FILTER (WHERE diff > 0) OVER (PARTITION BY query ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
      AS up_last3,
    regr_slope(v, CAST(idx AS DOUBLE)) OVER (PARTITION BY query) AS slope,
    count(v) OVER (PARTITION BY query) AS n_values,
    max(CASE WHEN idx = 0 THEN v END) OVER (PARTITION BY query) AS v_first
  FROM l WINDOW w14 AS (PARTITION BY query ORDER BY idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
  t AS (SELECT *, (n_posts >= 3 AND n_buckets >= 2) AS enough, v - v_2 AS recent,
    CASE WHEN n_buckets > 1 THEN v - v_1 END AS m1, CASE WHEN n_buckets > 3 THEN v - v_3 END AS m3,
    CASE WHEN n_buckets > 7 THEN v - v_7 END AS m7
  FROM r WHERE idx = n_buckets - 1)
SELECT query,
  CASE WHEN NOT enough OR n_buckets < 3 OR n_values < 2 THEN 'insufficient_data'
       WHEN abs(slope) < 0.05 AND abs(recent) < 0.1 THEN 'stable'
       WHEN slope > 0.05 OR recent > 0.1 THEN 'improving' ELSE 'worsening' END AS overall_trend,
  round(CASE WHEN enough THEN abs(v - v_first) ELSE 0.0 END, 6) AS trend_strength,
  round(CASE WHEN enough THEN slope END, 6) AS slope,
  round(CASE WHEN enough THEN (CASE WHEN n_buckets >= 7 THEN (v - v_6) / (v_6 + 0.001) * 100 ELSE 0.0 END) END, 6)
    AS rate_of_change,
  round(CASE WHEN enough THEN (CASE WHEN n_buckets < 14 THEN 50.0 WHEN n_diff14 < 14 THEN NULL
       WHEN avg_loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + avg_gain / avg_loss) END) END, 6) AS rsi,
  round(CASE WHEN n_posts >= 2 AND n_buckets >= 2 THEN m1 END, 6) AS momentum_1_day,
  round(CASE WHEN n_posts >= 2 AND n_buckets >= 2 THEN m3 END, 6) AS momentum_3_day,
  round(CASE WHEN n_posts >= 2 AND n_buckets >= 2 THEN m7 END, 6) AS momentum_7_day,
  round(CASE WHEN n_posts >= 2 AND n_buckets >= 2 THEN
        (CASE WHEN n_buckets >= 3 THEN (v - v_1) - (v_1 - v_2) ELSE 0.0 END) END, 6) AS acceleration,
  CASE WHEN n_posts >= 2 AND n_buckets >= 2 THEN
       (CASE WHEN (CASE WHEN n_buckets > 1 THEN m1 ELSE 0.0 END) + (CASE WHEN n_buckets > 3 THEN m3 ELSE 0.0 END)
                  + (CASE WHEN n_buckets > 7 THEN m7 ELSE 0.0 END) > 0 THEN 'positive' ELSE 'negative' END)
       END AS momentum_direction,
  round(CASE WHEN n_posts >= 7 THEN (CASE WHEN n_buckets >= 3 THEN CAST(up_last3 AS DOUBLE) / 3.0 ELSE 0.5 END) END, 6)
    AS trend_consistency,
  CAST(n_buckets AS BIGINT) AS days
FROM t
"""))
def q_trend_summary_by_query(spark, sf_dir):
    return rounded(S.trend_summary(gapped(spark, sf_dir), by=["query"]))


@register("volatility_by_platform", gap_oracle("""
, grid AS (
    SELECT platform, unit, unnest(generate_series(lo, hi, CASE unit WHEN 'day' THEN INTERVAL 1 DAY ELSE INTERVAL 1 HOUR END)) AS b
    FROM (SELECT platform, u.unit, min(date_trunc(u.unit, ts)) AS lo, max(date_trunc(u.unit, ts)) AS hi
          FROM flat, (VALUES ('day'), ('hour')) u(unit) GROUP BY platform, u.unit)),
  vals AS (SELECT platform, u.unit, date_trunc(u.unit, ts) AS b, avg(sentiment_value) AS v
           FROM flat, (VALUES ('day'), ('hour')) u(unit) GROUP BY ALL),
  seq AS (SELECT g.platform, g.unit, g.b, v.v,
                 lag(v.v) OVER (PARTITION BY g.platform, g.unit ORDER BY g.b) AS prev
          FROM grid g LEFT JOIN vals v ON v.platform = g.platform AND v.unit = g.unit AND v.b = g.b),
  pc AS (SELECT platform, unit, stddev_samp(CASE WHEN prev <> 0 THEN v / prev - 1 END) AS sd,
                count(CASE WHEN prev <> 0 THEN v / prev - 1 END) AS n_r,
                count(*) FILTER (WHERE prev = 0 AND v <> 0) AS n_inf FROM seq GROUP BY ALL),
  vol AS (SELECT platform, unit, CASE WHEN n_inf > 0 THEN NULL WHEN n_r = 0 THEN 0.0 ELSE sd END AS vol FROM pc),
  o AS (SELECT platform, stddev_samp(sentiment_value) AS sd, avg(sentiment_value) AS mu, count(*) AS n
        FROM flat GROUP BY platform)
SELECT o.platform,
       round(CASE WHEN o.n < 2 THEN 0.0 ELSE o.sd END, 6) AS overall,
       round(CASE WHEN o.n < 2 THEN 0.0 ELSE d.vol END, 6) AS daily,
       round(CASE WHEN o.n < 2 THEN 0.0 ELSE h.vol END, 6) AS hourly,
       round(CASE WHEN o.n < 2 THEN NULL WHEN o.mu <> 0 THEN o.sd / abs(o.mu) ELSE 0.0 END, 6) AS coefficient_of_variation
FROM o JOIN vol d ON d.platform = o.platform AND d.unit = 'day'
       JOIN vol h ON h.platform = o.platform AND h.unit = 'hour'
"""))
def q_volatility_by_platform(spark, sf_dir):
    return rounded(S.volatility(gapped(spark, sf_dir), by=["platform"]))


# --------------------------------------------------------------------------- documents, charts, report lists

def _landing(spark, name):
    import uuid

    from chorus.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("analysis_document", oracle("""
SELECT seq, id, platform, author, md5(content) AS content_md5, title, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
       round(engagement_total, 6) AS engagement_total, query, CASE WHEN sentiment <> 'UNKNOWN' THEN sentiment END AS sentiment
FROM flat"""))
def q_analysis_document(spark, sf_dir):
    """All posts written as one JSON document and read back at its objects' borders."""
    from chorus.functions import columns as C
    from chorus.plans import export as E
    from chorus.schema import POST_SCHEMA
    from chorus.sources import ingest as I
    path = f"{_landing(spark, 'document')}.json"
    E.write_analysis_document({}, posts(spark, sf_dir), path, {"queries": ["all"]})
    p = I.read_analysis_posts(spark, path, POST_SCHEMA)
    return rounded(p.select("seq", "id", "platform", "author", F.md5("content").alias("content_md5"), "title",
                            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
                            C.engagement_total().alias("engagement_total"), "query", F.col("sentiment.label").alias("sentiment")))


@register("graph_document", oracle(_MENTION_SQL + "SELECT src, dst, weight FROM mg"))
def q_graph_document(spark, sf_dir):
    """The mention graph written as one node-link document and read back with its types."""
    from chorus.plans import export as E
    from chorus.sources import ingest as I
    path = f"{_landing(spark, 'graph')}.json"
    g = G.mention_graph(G.mention_edges(posts(spark, sf_dir))).select("src", "dst", "weight")
    nodes = g.select(F.col("src").alias("id")).union(g.select("dst")).distinct()
    E.write_node_link(nodes, g, path, document=True)
    weight = g.schema["weight"].dataType
    _, links = I.read_graph(spark, path, nodes.schema, T.StructType().add("source", "string").add("target", "string").add("weight", weight))
    return links.select("src", "dst", "weight")


_EMOJI = sorted(X.emoji_names())


@register("clean_text_emoji", oracle(f"""
, e AS (SELECT [{", ".join("'" + X.emoji_names()[e] + "'" for e in _EMOJI)}] AS names),
t AS (SELECT seq, content || ' ' || ' ' || names[seq % {len(_EMOJI)} + 1] || ' ' || 'end' AS c FROM posts, e)
SELECT seq, md5(c) AS cleaned_md5, CAST(length(c) AS BIGINT) AS cleaned_length
FROM (SELECT seq, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '{X.URL}', '', 'g'),
        '@({X.WORD}+)', '\\1', 'g'), '{X.HASHTAG}', '\\1', 'g'), '{X.SPACE}+', ' ', 'g')) AS c FROM t)"""))
def q_clean_text_emoji(spark, sf_dir):
    """P9 with an emoji in every post, all names of the table in turn."""
    p = posts(spark, sf_dir)
    emoji = F.element_at(F.split(F.lit("|".join(_EMOJI)), "[|]"), (F.col("seq") % len(_EMOJI) + 1).cast("int"))
    c = X.clean_text(F.concat("content", F.lit(" "), emoji, F.lit("end")))
    return p.select("seq", F.md5(c).alias("cleaned_md5"), F.char_length(c).cast("bigint").alias("cleaned_length"))


@register("posts_in_lookback", oracle("SELECT seq FROM posts WHERE ts >= TIMESTAMP '2024-01-18 12:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00'"))
def q_posts_in_lookback(spark, sf_dir):
    import datetime as dt
    start, end = FL.lookback_range(7, dt.datetime(2024, 1, 25, 12))
    return FL.in_date_range(posts(spark, sf_dir), start, end).select("seq")


@register("tweet_media", oracle("""
SELECT id, seq, array_to_string(list_transform(range(seq % 3), lambda i: CASE WHEN i = 0 THEN 'photo' ELSE 'video' END), '|') AS media_types,
       CASE WHEN seq % 4 = 0 THEN CAST(seq % 90 AS DOUBLE) END AS lat, CASE WHEN seq % 4 = 0 THEN CAST(seq % 180 AS DOUBLE) END AS lon
FROM posts WHERE platform = 'twitter'"""))
def q_tweet_media(spark, sf_dir):
    """Media types and coordinates of landed tweets."""
    from chorus.sources import ingest as I
    k = F.col("seq")
    media = F.transform(F.slice(F.array(F.lit("photo"), F.lit("video")), 1, (k % 3).cast("int")), lambda m: F.struct(m.alias("type")))
    place = F.when(k % 4 == 0, F.struct((k % 90).cast("double").alias("latitude"), (k % 180).cast("double").alias("longitude")))
    raw = posts(spark, sf_dir).where("platform = 'twitter'").select("seq", F.to_json(F.struct("id", F.col("timestamp").alias("date"), media.alias("media"),
                                                                                              place.alias("coordinates"))).alias("value"))
    tweets = raw.select("seq", F.from_json("value", I.TWEET_SCHEMA).alias("t")).select("seq", "t.*")
    p = I.tweets_to_posts(tweets, "landed", F.col("seq"))
    return p.select("id", "seq", F.array_join("metadata.media_types", "|").alias("media_types"),
                    F.col("metadata.coordinates.lat").alias("lat"), F.col("metadata.coordinates.lon").alias("lon"))


def _chart(name):
    def run(spark, sf_dir):
        from chorus.plans import export as E
        return rounded(E.chart_tables(flat(spark, sf_dir), posts(spark, sf_dir))[name])
    return run


for _name, _sql in (("sentiment_pie", oracle("SELECT sentiment, count(*) AS count FROM flat GROUP BY sentiment")),
                    ("sentiment_bar", oracle("SELECT sentiment, count(*) AS count FROM flat GROUP BY sentiment")),
                    ("platform_comparison", f"SELECT * FROM {_sub('by_platform')}"),
                    ("top_hashtags", f"SELECT * FROM {_sub('top_hashtags')} ORDER BY count DESC, term LIMIT 10")):
    register(f"chart_{_name}", _sql)(_chart(_name))


@register("report_top_hashtags", f"SELECT * FROM {_sub('top_hashtags')} ORDER BY count DESC, term LIMIT 20")
def q_report_top_hashtags(spark, sf_dir):
    from chorus.plans import export as E
    return E.report_cuts({"top_hashtags": A.top_terms(posts(spark, sf_dir), "hashtags")})["top_hashtags"]


@register("report_most_active_authors", f"SELECT * FROM {_sub('most_active_authors')} ORDER BY posts DESC, author LIMIT 10")
def q_report_most_active_authors(spark, sf_dir):
    from chorus.plans import export as E
    return E.report_cuts({"most_active_authors": A.most_active_authors(flat(spark, sf_dir))})["most_active_authors"]


@register("report_anomalies", f"SELECT * FROM {_sub('anomalies_by_query')} ORDER BY abs(z_score) DESC, date LIMIT 10")
def q_report_anomalies(spark, sf_dir):
    from chorus.plans import export as E
    return rounded(E.report_cuts({"ts_anomalies": QUERIES["anomalies_by_query"](spark, sf_dir)})["ts_anomalies"])
