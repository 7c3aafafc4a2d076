"""Aggregations over posts.

Inputs are ``posts_flat`` frames.  Every statistic is a hash aggregate (with
map-side partial aggregation) or a distributed top-k (``orderBy().limit()``
plans as TakeOrderedAndProject; ``row_number() <= k`` per group plans a
WindowGroupLimit below the shuffle).  Per-dataset thresholds (mean + std,
percentiles) are scalar subqueries: evaluated once, then used as literals.
Dict-shaped results of the reference become long tables or one-row frames.

Ties (the reference follows input order, which a distributed table lacks):
top-k lists break ties on the key ascending; "first" means smallest ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.functions import columns as C
from chorus.session import ensure_checkpoint_dir

LABELS = ("POSITIVE", "NEGATIVE", "NEUTRAL")


def _n():
    return F.count(F.lit(1))


def date_range(flat: DataFrame) -> DataFrame:
    """A1: total posts, first/last timestamp, calendar span in days and whole hours."""
    lo, hi = F.min("timestamp"), F.max("timestamp")
    t = flat.agg(_n().alias("total_posts"), lo.alias("lo"), hi.alias("hi"))
    diff_us = C.micros_between("lo", "hi")
    return t.select("total_posts",
                    C.iso_timestamp("lo").alias("start"), C.iso_timestamp("hi").alias("end"),
                    (F.floor(diff_us / F.lit(86_400_000_000)) + 1).cast("bigint").alias("days"),
                    F.floor(diff_us / F.lit(3_600_000_000)).cast("bigint").alias("total_hours"))


def count_by(flat: DataFrame, *keys: str) -> DataFrame:
    """Post counts per key combination."""
    return flat.groupBy(*keys).agg(_n().alias("count"))


def by_platform(flat):
    return count_by(flat, "platform")


def by_query(flat):
    return count_by(flat, "query")


def sentiment_distribution(flat: DataFrame) -> DataFrame:
    """A4: count and percent of posts per label."""
    counts = count_by(flat, "sentiment")
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))  # one row per label
    return counts.select("sentiment", "count", (F.col("count") / total * 100).alias("percentage"))


def sentiment_summary(flat: DataFrame) -> DataFrame:
    """A4: total, ``(pos − neg) / total`` and the dominant label (ties: alphabetical)."""
    return label_summary(count_by(flat, "sentiment"))


def label_summary(counts: DataFrame) -> DataFrame:
    """A4 from the counts per label (``sentiment``, ``count``)."""
    return counts.agg(
        F.sum("count").alias("total"),
        (F.try_divide(F.sum(F.when(F.col("sentiment") == "POSITIVE", F.col("count")).otherwise(0))
                      - F.sum(F.when(F.col("sentiment") == "NEGATIVE", F.col("count")).otherwise(0)),
                      F.sum("count"))).alias("sentiment_ratio"),
        F.min_by("sentiment", F.struct(-F.col("count"), F.col("sentiment"))).alias("dominant_sentiment"))


def sentiment_by(flat: DataFrame, key: str) -> DataFrame:
    """Label counts per platform or per query."""
    return count_by(flat, key, "sentiment")


def engagement_stats(flat: DataFrame) -> DataFrame:
    """Engagement totals, means, median, maxima, sample std and two counts (one read of the posts)."""
    cells = value_cells(flat, F.col("engagement_total"),
                        *[f(c).alias(f"{name}_{c}") for c in ("likes", "shares")
                          for name, f in (("sum", F.sum), ("n", F.count), ("max", F.max))])
    x, n = F.col("x"), F.col("n")
    mean, std = cell_mean(cells).scalar(), cell_std(cells).scalar()
    median = cell_percentiles(cells, [0.5]).select("p0").scalar()
    return cells.agg(
        F.sum("sum_likes").cast("bigint").alias("total_likes"),
        F.sum("sum_shares").cast("bigint").alias("total_shares"),
        F.sum(x * n).cast("bigint").alias("total_engagement"),
        F.try_divide(F.sum("sum_likes"), F.sum("n_likes")).alias("avg_likes"),
        F.try_divide(F.sum("sum_shares"), F.sum("n_shares")).alias("avg_shares"),
        F.max(mean).alias("avg_engagement"),
        F.max(median).alias("median_engagement"),
        F.max("max_likes").cast("bigint").alias("max_likes"),
        F.max("max_shares").cast("bigint").alias("max_shares"),
        F.max(x).cast("bigint").alias("max_engagement"),
        F.max(std).alias("engagement_std"),
        F.coalesce(F.sum(F.when(x > mean + std, n)), F.lit(0)).alias("high_engagement_posts"),
        F.coalesce(F.sum(F.when(x == 0, n)), F.lit(0)).alias("zero_engagement_posts"))


def value_cells(df: DataFrame, value, *aggs) -> DataFrame:
    """Rows counted by value: ``x`` (double; a row for null, too), ``n``, ``aggs``, ``part``.

    One read of ``df`` with a map-side combine; the cells are range-partitioned and written once, so every
    moment, rank and count over the values is read from them and no task holds all values.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df.groupBy(value.cast("double").alias("x")).agg(_n().alias("n"), *aggs)
            .repartitionByRange("x").withColumn("part", F.spark_partition_id()).checkpoint(eager=True))


def cell_mean(cells: DataFrame) -> DataFrame:
    """The mean of the values, in one row (null without values)."""
    return cells.filter(F.col("x").isNotNull()).agg(F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum("n")).alias("mean"))


def cell_std(cells: DataFrame) -> DataFrame:
    """The sample standard deviation of the values, in one row (null below two values)."""
    off = F.col("x") - cell_mean(cells).scalar()
    return cells.filter(F.col("x").isNotNull()).agg(F.sqrt(F.try_divide(F.sum(off * off * F.col("n")), F.sum("n") - 1)).alias("std"))


def cell_ranks(cells: DataFrame) -> DataFrame:
    """``x`` with the ranks ``lo`` <= r < ``hi`` (from 0) that its rows take and the ``total``; each partition's
    offset is the sum of the counts before it."""
    cells = cells.filter(F.col("x").isNotNull()).select("x", "n", "part")
    per = cells.groupBy("part").agg(F.sum("n").alias("m"))  # one row per partition
    before = per.select("part", (F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("m")).alias("before"),
                        F.sum("m").over(Window.partitionBy(F.lit(0))).alias("total"))
    ends = F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    return cells.withColumn("e", ends).join(before, "part").select(
        "x", (F.col("before") + F.col("e") - F.col("n")).alias("lo"), (F.col("before") + F.col("e")).alias("hi"), "total")


def cell_percentiles(cells: DataFrame, ps: list[float]) -> DataFrame:
    """Exact percentiles (linear interpolation) in one row: ``p0``, ``p1``, … doubles, null without values."""
    picks = []
    for i, p in enumerate(ps):
        rank = (F.col("total") - 1) * F.lit(float(p))
        for name, r in (("a", F.floor(rank)), ("b", F.ceil(rank))):
            picks.append(F.max(F.when((F.col("lo") <= r) & (r < F.col("hi")), F.col("x"))).alias(f"{name}{i}"))
    t = cell_ranks(cells).agg(F.max("total").alias("total"), *picks)
    out = []
    for i, p in enumerate(ps):
        rank = (F.col("total") - 1) * F.lit(float(p))
        share = rank - F.floor(rank)
        out.append((F.col(f"a{i}") * (1 - share) + F.col(f"b{i}") * share).alias(f"p{i}"))
    return t.select(*out)


def percentiles(df: DataFrame, col: str, ps: list[float]) -> DataFrame:
    """Exact percentiles of a column, see :func:`value_cells` and :func:`cell_percentiles`."""
    return cell_percentiles(value_cells(df, F.col(col)), ps)


def author_counts(flat: DataFrame) -> DataFrame:
    return flat.filter(F.col("author").isNotNull()).groupBy("author").agg(_n().alias("posts"))


def author_stats(flat: DataFrame) -> DataFrame:
    """Authors, posts per author (mean/median/max/std), singles, prolific, top-10 share.

    One read of the posts; the authors are counted by their number of posts and everything follows from
    those counts (posts without an author are the cell without a value).
    """
    per = flat.groupBy("author").agg(_n().alias("posts"))
    cells = value_cells(per, F.when(F.col("author").isNotNull(), F.col("posts")), F.sum("posts").alias("posts"))
    x, n = F.col("x"), F.when(F.col("x").isNotNull(), F.col("n"))
    ranks = cell_ranks(cells)
    top = F.greatest(F.col("hi") - F.greatest("lo", F.col("total") - 10), F.lit(0))  # of the ten highest ranks
    top10 = ranks.select(F.sum(x * top)).scalar()
    mean, std = cell_mean(cells).scalar(), cell_std(cells).scalar()
    median = cell_percentiles(cells, [0.5]).select("p0").scalar()
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return cells.agg(
        count(n).alias("unique_authors"),
        F.max(mean).alias("mean_posts"),
        F.max(median).alias("median_posts"),
        F.max(x).cast("bigint").alias("max_posts"),
        F.max(std).alias("std_posts"),
        count(F.when(x == 1, n)).alias("single_post_authors"),
        count(F.when(x >= 10, n)).alias("prolific_authors"),
        F.try_divide(F.max(top10), F.sum("posts")).alias("author_concentration"))


def most_active_authors(flat: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` authors by posts (ties: author name)."""
    return author_counts(flat).orderBy(F.col("posts").desc(), F.col("author")).limit(top)


def content_stats(flat: DataFrame) -> DataFrame:
    """A10: content length and hashtag/mention/media/title usage (one read of the posts)."""
    terms = ("hashtag", "mention")
    cells = value_cells(flat, F.col("content_length"), F.count_if("has_media").alias("media"), F.count_if("has_title").alias("title"),
                        *[a for t in terms for a in (F.count_if(F.col(f"{t}_count") > 0).alias(f"has_{t}"), F.sum(f"{t}_count").alias(f"sum_{t}"),
                                                     F.count(f"{t}_count").alias(f"n_{t}"))])
    mean, median = cell_mean(cells).scalar(), cell_percentiles(cells, [0.5]).select("p0").scalar()
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return cells.agg(
        F.max(mean).alias("avg_length"), F.max(median).alias("median_length"),
        F.max("x").cast("bigint").alias("max_length"), F.min("x").cast("bigint").alias("min_length"),
        *[count(f"has_{t}").alias(f"with_{t}s") for t in terms],
        count("media").alias("with_media"), count("title").alias("with_title"),
        *[F.try_divide(F.sum(f"has_{t}"), F.sum(f"n_{t}")).alias(f"{t}_usage_rate") for t in terms],
        *[F.try_divide(F.sum(f"sum_{t}"), F.sum(f"n_{t}")).alias(f"avg_{t}s_per_post") for t in terms])


def posts_by_hour(flat: DataFrame) -> DataFrame:
    """Posts per observed hour of day."""
    return count_by(flat, "hour")


def posts_by_day_of_week(flat: DataFrame) -> DataFrame:
    """Posts per weekday, Monday..Sunday, zero-filled (7-row dimension)."""
    spark = flat.sparkSession
    days = spark.range(7).select(
        F.element_at(F.array(*[F.lit(d) for d in C.WEEKDAYS]), (F.col("id") + 1).cast("int")).alias("day_of_week"),
        F.col("id").alias("day_index"))
    counts = count_by(flat, "day_of_week")
    return (F.broadcast(days).join(counts, "day_of_week", "left")
            .select("day_of_week", "day_index", F.coalesce("count", F.lit(0)).alias("count")))


def posts_by_date(flat: DataFrame) -> DataFrame:
    """Posts per calendar day."""
    return flat.groupBy(C.date_string("timestamp").alias("date")).agg(_n().alias("count"))


def temporal_summary(flat: DataFrame) -> DataFrame:
    """A14 + A16: peak hour/day (mode, lowest on ties) and day-part counts."""
    h = F.col("hour")
    weekend = F.col("day_of_week").isin("Saturday", "Sunday")
    return flat.agg(
        F.mode("hour", True).alias("peak_hour"),
        F.mode("day_of_week", True).alias("peak_day"),
        F.count_if(weekend).alias("weekend_posts"),
        F.count_if(~weekend).alias("weekday_posts"),
        F.count_if(h.between(0, 6)).alias("night_posts"),
        F.count_if(h.between(7, 18)).alias("day_posts"),
        F.count_if(h.between(19, 23)).alias("evening_posts"))


def high_activity_hours(flat: DataFrame) -> DataFrame:
    """Hours busier than the mean over observed hours (≤ 24 rows)."""
    per = posts_by_hour(flat)
    mean = per.select(F.avg("count")).scalar()
    return per.filter(F.col("count") > mean)


def _term_counts(flat_terms: DataFrame, col: str) -> DataFrame:
    return (flat_terms.select(F.explode(F.col(col)).alias("term"))
            .filter(F.col("term").isNotNull())
            .groupBy(F.lower("term").alias("term")).agg(_n().alias("count")))


def top_terms(posts: DataFrame, field: str = "hashtags", top: int = 20) -> DataFrame:
    """The ``top`` most used lower-cased hashtags or mentions."""
    counts = _term_counts(posts.select(F.col(f"metadata.{field}").alias("t")), "t")
    return counts.orderBy(F.col("count").desc(), F.col("term")).limit(top)


def term_summary(posts: DataFrame, field: str = "hashtags", frequent: int = 10) -> DataFrame:
    """Unique and total terms, used once, used ≥ ``frequent`` times."""
    counts = _term_counts(posts.select(F.col(f"metadata.{field}").alias("t")), "t")
    return counts.agg(_n().alias("unique_terms"),
                      F.coalesce(F.sum("count"), F.lit(0)).alias("total_terms"),
                      F.count_if(F.col("count") == 1).alias("single_use"),
                      F.count_if(F.col("count") >= frequent).alias("frequent"))


def negative_users(flat: DataFrame, min_posts: int = 3, threshold: float = 0.6, top: int = 50) -> DataFrame:
    """Authors with ≥ ``min_posts`` posts and a negative share ≥ ``threshold``."""
    lab = F.col("sentiment")
    per = (flat.filter(F.col("author").isNotNull()).groupBy("author")
           .agg(F.count("id").alias("post_count"),
                _n().alias("labelled"),
                F.count_if(lab == "NEGATIVE").alias("negative_posts"),
                F.count_if(lab == "POSITIVE").alias("positive_posts"),
                F.count_if(lab == "NEUTRAL").alias("neutral_posts"),
                F.avg("sentiment_score").alias("avg_sentiment_score"),
                F.min_by("platform", "seq").alias("platform"),
                F.avg("engagement_total").alias("avg_engagement")))
    ratio = F.col("negative_posts") / F.col("labelled")
    out = (per.filter(F.col("post_count") >= min_posts)
              .select("*", ratio.alias("negative_ratio"))
              .filter(F.col("negative_ratio") >= threshold))
    return (out.orderBy(F.col("negative_ratio").desc(), F.col("author")).limit(top)
               .select("author", "platform", "post_count", "negative_ratio", "negative_posts",
                       "positive_posts", "neutral_posts", "avg_sentiment_score", "avg_engagement"))


def viral_threshold(flat: DataFrame) -> DataFrame:
    """A20 threshold (one row): p90 below 10 posts, else min(p95, mean + 2 std);
    never below twice the median.  Percentiles are exact; the posts are read once.
    """
    cells = value_cells(flat, F.col("engagement_total"))
    pct = cell_percentiles(cells, [0.5, 0.9, 0.95])
    med, p90, p95 = (F.max(pct.select(f"p{i}").scalar()) for i in range(3))
    mean, std = cell_mean(cells).scalar(), cell_std(cells).scalar()
    t = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), p90.alias("p90"), p95.alias("p95"),
                  F.max(mean + 2 * std).alias("m2s"), med.alias("med"))
    base = F.when(F.col("n") < 10, F.col("p90")).otherwise(F.least("p95", "m2s"))
    return t.select(F.greatest(base, 2 * F.col("med")).alias("threshold"))


def viral_posts(flat: DataFrame, posts: DataFrame | None = None, top: int = 20) -> DataFrame:
    """Posts at or above the viral threshold, most engaging first.

    The ranking runs on ``flat`` (no text).  ``content``/``url`` come from
    ``flat`` when it carries them, else from ``posts`` for the ≤ ``top``
    winners only.
    """
    thr = viral_threshold(flat).scalar()
    e = F.col("engagement_total")
    cols = ["seq", "id", "platform", "author", "engagement_total", "likes", "shares", "sentiment", "timestamp"]
    has_text = "content" in flat.columns
    best = (flat.filter(e >= thr).orderBy(e.desc(), F.col("seq")).limit(top)
            .select(*cols, *(["content", "url"] if has_text else [])))
    if not has_text:
        best = posts.select("seq", "content", "url").join(best, "seq")
    return best.orderBy(e.desc(), F.col("seq")).select("id", "platform", "author", e.cast("bigint").alias("engagement"),
                       F.col("likes").cast("bigint").alias("likes"), F.col("shares").cast("bigint").alias("shares"),
                       "sentiment", C.preview("content", 200).alias("content_preview"),
                       C.iso_timestamp("timestamp").alias("timestamp"), "url")


def sentiment_leaders(flat: DataFrame, min_posts: int = 2, top: int = 10) -> DataFrame:
    """Per dominant label, the ``top`` authors by total engagement."""
    grand = flat.select(F.sum("engagement_total")).scalar()
    per = (flat.filter(F.col("author").isNotNull()).groupBy("author")
           .agg(F.sum("engagement_total").alias("total"), F.avg("engagement_total").alias("avg_engagement"),
                F.mode("sentiment", True).alias("dominant"), F.count("id").alias("post_count"))
           .filter((F.col("post_count") >= min_posts) & F.col("dominant").isin(*LABELS)))
    rk = F.row_number().over(Window.partitionBy("dominant").orderBy(F.col("total").desc(), F.col("author")))
    return (per.select("*", rk.alias("rank")).filter(F.col("rank") <= top)
               .select(F.lower("dominant").alias("sentiment"), F.col("rank").cast("bigint").alias("rank"), "author",
                       F.col("total").cast("bigint").alias("total_engagement"), "avg_engagement", "post_count",
                       F.when(grand > 0, F.col("total") / grand).otherwise(F.lit(0.0)).alias("influence_score")))


def user_cells(flat: DataFrame) -> DataFrame:
    """Scored posts counted per (author, query, subreddit): what every per-user table is made from."""
    lab = F.col("sentiment")
    return (flat.filter(F.col("has_sentiment")).groupBy("author", "query", "subreddit")
            .agg(_n().alias("n"), F.count_if(lab == "POSITIVE").alias("positive"), F.count_if(lab == "NEGATIVE").alias("negative"),
                 F.count_if(lab == "NEUTRAL").alias("neutral"), F.sum("engagement_total").alias("engagement"),
                 F.min("seq").alias("first_seq")))


def user_patterns(flat: DataFrame) -> DataFrame:
    """Per author over scored posts — label counts, engagement, ratios, user type.

    One scan: cells, then one row per (author, query), then one per author; subreddits are counted from
    the same cells.
    """
    cells = user_cells(flat)
    sums = ("n", "positive", "negative", "neutral", "engagement")
    topics = cells.groupBy("author", "query").agg(*[F.sum(c).alias(c) for c in sums], F.min("first_seq").alias("first_seq"))
    per = topics.groupBy("author").agg(*[F.sum(c).alias(c) for c in sums], F.min("first_seq").alias("first_seq"),
                                       F.count("query").alias("n_topics"))
    subs = cells.groupBy("author", "subreddit").agg(F.lit(1)).groupBy("author").agg(F.count("subreddit").alias("n_subreddits"))
    per = per.join(subs.withColumnRenamed("author", "_author"), F.col("author").eqNullSafe(F.col("_author")), "left").drop("_author")
    n = F.col("n")
    other = n - F.col("positive") - F.col("negative") - F.col("neutral")
    share = F.greatest("positive", "negative", "neutral", other) / n
    top = (F.when(F.col("positive") / n == share, F.lit("POSITIVE")).when(F.col("negative") / n == share, F.lit("NEGATIVE"))
            .when(F.col("neutral") / n == share, F.lit("NEUTRAL")).otherwise(F.lit("UNKNOWN")))
    user_type = F.when(share >= 0.7, top).when(share >= 0.4, F.lit("MIXED")).otherwise(F.lit("NEUTRAL"))
    return per.select("author", n.alias("post_count"), "positive", "negative", "neutral", F.col("engagement").alias("total_engagement"),
                      (F.col("engagement") / n).alias("avg_engagement"),
                      ((F.col("positive") - F.col("negative")) / n).alias("sentiment_score"),
                      (F.col("positive") / n).alias("positivity_ratio"),
                      (F.col("negative") / n).alias("negativity_ratio"),
                      user_type.alias("user_type"), "n_topics", "n_subreddits", "first_seq")


def user_term_counts(flat: DataFrame, kind: str = "topic") -> DataFrame:
    """Per author the count of posts per topic (query) or subreddit."""
    col = "query" if kind == "topic" else "subreddit"
    return (flat.filter(F.col("has_sentiment") & F.col(col).isNotNull() & (F.length(col) > 0))
            .groupBy("author", F.col(col).alias("term")).agg(_n().alias("count")))


def engagement_heatmap(posts: DataFrame, wide: bool = False) -> DataFrame:
    """Mean of likes + retweets by weekday × hour.

    Long form by default; ``wide=True`` pivots hours into 24 columns (the
    values are listed, so no extra job collects distinct hours).
    """
    e = posts.select(C.weekday_name("timestamp").alias("day"), F.hour("timestamp").cast("bigint").alias("hour"),
                     (F.coalesce(F.try_element_at("engagement", F.lit("likes")), F.lit(0.0))
                      + F.coalesce(F.try_element_at("engagement", F.lit("retweets")), F.lit(0.0))).alias("e"))
    if wide:
        return e.groupBy("day").pivot("hour", list(range(24))).agg(F.avg("e"))
    return e.groupBy("day", "hour").agg(F.avg("e").alias("avg_engagement"))


def topic_sentiment_heatmap(flat: DataFrame, min_posts: int = 2, max_users: int = 30) -> DataFrame:
    """Mean label value per (user, topic) for the first ``max_users``
    users (by first scored post) having ≥ ``min_posts`` scored posts."""
    scored = flat.filter(F.col("has_sentiment"))
    users = (scored.groupBy("author").agg(_n().alias("post_count"), F.min("seq").alias("first_seq"))
             .filter(F.col("post_count") >= min_posts)
             .orderBy("first_seq").limit(max_users))
    picked = scored.join(users, "author")  # filter before aggregating
    cells = picked.groupBy("author", "post_count", F.col("query").alias("topic")).agg(
        F.avg(C.label_value("sentiment")).alias("avg_sentiment"), _n().alias("posts"))
    return cells.select("author", "post_count", "topic", "avg_sentiment", "posts")


def user_leaderboards(flat: DataFrame, top: int = 20, min_posts: int = 2, ratio_min_posts: int = 3) -> DataFrame:
    """Four top-``top`` boards over authors with ≥ ``min_posts`` scored posts."""
    u = user_patterns(flat).filter(F.col("post_count") >= min_posts)
    enough = F.col("post_count") >= ratio_min_posts
    entry = lambda name, value, cond=F.lit(True): F.when(cond, F.struct(
        F.lit(name).alias("board"), value.cast("double").alias("value")))
    boards = F.array_compact(F.array(
        entry("most_posts", F.col("post_count")),
        entry("most_positive", F.col("positivity_ratio"), enough & (F.col("positivity_ratio") > 0.5)),
        entry("most_negative", F.col("negativity_ratio"), enough & (F.col("negativity_ratio") > 0.5)),
        entry("top_engagement", F.col("avg_engagement"))))
    rk = F.row_number().over(Window.partitionBy("board").orderBy(F.col("value").desc(), F.col("first_seq")))
    return (u.select("author", "first_seq", F.inline(boards)).select("board", rk.cast("bigint").alias("rank"), "author", "value")
            .filter(F.col("rank") <= top))
