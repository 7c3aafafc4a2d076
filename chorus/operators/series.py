"""Time series over posts.

Every operator works on ``posts_flat`` (``chorus.operators.project``).  Posts
are first aggregated per calendar bucket (a hash aggregate with map-side
combine), then joined to a gap-filled calendar grid.  Window functions only
run over the grid — one row per day or hour, never one row per post — so
they stay small whatever the data volume.  ``by`` optionally names keys
(e.g. ``["platform"]`` or ``["query"]``) that partition every series; with no
``by`` a literal ``_series`` key stands for the single series, so per-series
statistics are always combined by equi-joins on the series key.

Conventions: pandas NaN is SQL NULL here; sample statistics (ddof = 1);
positions like ``v[-3]`` count grid buckets, gap buckets included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.functions import columns as C

UNITS = {"day": "INTERVAL 1 DAY", "hour": "INTERVAL 1 HOUR"}
SERIES = "_series"


def _prep(flat: DataFrame, by):
    """Return (frame with series key, grouping keys, public keys)."""
    if by:
        keys = list(by)
        return flat, keys, keys
    return flat.withColumn(SERIES, F.lit(0)), [SERIES], []


def _buckets(flat: DataFrame, keys, unit: str) -> DataFrame:
    b = F.date_trunc(unit, "timestamp").cast("timestamp_ntz")
    return (flat.groupBy(*keys, b.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("count"),
                 F.avg("sentiment_value").alias("v"),
                 F.sum("engagement_total").alias("engagement_sum"),
                 F.avg("engagement_total").alias("engagement_mean"),
                 F.max("engagement_total").alias("engagement_max")))


MAX_BUCKETS = 2_000_000  # 228 years of hours; one stamp far off the rest must not blow up the calendar


def _grid(flat: DataFrame, keys, unit: str, per_bucket: DataFrame | None = None) -> DataFrame:
    """The calendar of each series joined with its buckets.  A calendar of more than ``MAX_BUCKETS`` raises
    an error (a wrong time stamp), it never drops rows."""
    per_bucket = _buckets(flat, keys, unit) if per_bucket is None else per_bucket
    bounds = per_bucket.groupBy(*keys).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"),
                                           F.sum("count").alias("n_posts"))
    seconds = 86400 if unit == "day" else 3600
    span = C.micros_between("lo", "hi") / F.lit(1_000_000 * seconds)
    lo = F.when(span > MAX_BUCKETS, F.raise_error(F.concat(F.lit("time series too long: "), F.col("lo").cast("string"), F.lit(" to "),
                                                           F.col("hi").cast("string"))).cast("timestamp_ntz")).otherwise(F.col("lo"))
    bounds = bounds.withColumn("lo", lo)
    n_buckets = (F.size(F.sequence("lo", "hi", F.expr(UNITS[unit])))).alias("n_buckets")
    grid = bounds.select(*keys, "n_posts", n_buckets,
                         F.posexplode(F.sequence("lo", "hi", F.expr(UNITS[unit]))).alias("idx", "bucket"))
    out = grid.join(per_bucket, [*keys, "bucket"], "left")
    return out.select(*keys, "bucket", "idx", F.col("n_buckets").cast("bigint").alias("n_buckets"),
                      "n_posts", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "v",
                      F.coalesce("engagement_sum", F.lit(0.0)).alias("engagement_sum"),
                      "engagement_mean", "engagement_max")


def beside(keys, *frames: DataFrame) -> DataFrame:
    """One row per series from frames of one row per series with different columns: a union and an
    aggregate on the series key (a join on a constant key would plan as a cartesian product)."""
    names = [c for f in frames for c in f.columns if c not in keys]
    types = {c: f.schema[c].dataType for f in frames for c in f.columns}
    rows = [f.select(*keys, *[F.col(c) if c in f.columns else F.lit(None).cast(types[c]).alias(c) for c in names]) for f in frames]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def time_grid(flat: DataFrame, unit: str = "day", by=None) -> DataFrame:
    """Gap-filled calendar from the first to the last bucket.

    Columns: ``by`` keys, ``bucket`` (timestamp), ``idx`` (0-based position),
    ``n_buckets``, ``n_posts`` (posts in the whole series), ``count`` (posts
    in the bucket, 0 in gaps), ``v`` (mean sentiment value, null in gaps),
    ``engagement_sum`` (0 in gaps), ``engagement_mean`` / ``engagement_max``.
    """
    flat, keys, pub = _prep(flat, by)
    return _grid(flat, keys, unit).drop(*[k for k in keys if k not in pub])


def daily_sentiment(flat: DataFrame, by=None) -> DataFrame:
    """One row per observed day (empty days are skipped)."""
    flat, keys, pub = _prep(flat, by)
    lab = F.col("sentiment")
    agg = (flat.groupBy(*pub, F.to_date("timestamp").alias("day"))
           .agg(F.count_if(lab == "POSITIVE").alias("positive"),
                F.count_if(lab == "NEGATIVE").alias("negative"),
                F.count_if(lab == "NEUTRAL").alias("neutral"),
                F.count(F.lit(1)).alias("total"),
                F.avg("sentiment_value").alias("avg_sentiment"),
                F.coalesce(F.stddev_samp("sentiment_value"), F.lit(0.0)).alias("sentiment_std"),
                F.sum("engagement_total").alias("engagement_sum"),
                F.avg("engagement_total").alias("avg_engagement"),
                F.max("engagement_total").alias("engagement_max"),
                F.countDistinct("author").alias("unique_authors")))
    total = F.col("total")
    return agg.select(
        *pub, C.date_string("day").alias("date"),
        "positive", "negative", "neutral", "total",
        ((F.col("positive") - F.col("negative")) / total).alias("sentiment_ratio"),
        (F.col("positive") / total).alias("positive_ratio"),
        "avg_sentiment", "sentiment_std",
        F.col("engagement_sum").cast("bigint").alias("total_engagement"),
        "avg_engagement",
        F.col("engagement_max").cast("bigint").alias("max_engagement"),
        "unique_authors",
        F.when(F.col("unique_authors") > 0, total / F.col("unique_authors")).otherwise(F.lit(0.0))
         .alias("posts_per_author"),
    )


def hourly_sentiment(flat: DataFrame, by=None) -> DataFrame:
    """Per hour of day — mean sentiment value, posts, mean engagement."""
    pub = list(by) if by else []
    return (flat.groupBy(*pub, "hour")
            .agg(F.avg("sentiment_value").alias("avg_sentiment"),
                 F.count(F.lit(1)).alias("post_count"),
                 F.avg("engagement_total").alias("avg_engagement")))


def daily_trend(flat: DataFrame, by=None, min_posts: int = 3) -> DataFrame:
    """T4: daily mean on the grid plus 3- and 7-day moving averages.

    Empty when the series has fewer than ``min_posts`` posts or 2 days.
    """
    flat, keys, pub = _prep(flat, by)
    g = _grid(flat, keys, "day").filter((F.col("n_posts") >= min_posts) & (F.col("n_buckets") >= 2))
    w = Window.partitionBy(*keys).orderBy("idx")
    return g.select(*pub, C.date_string("bucket").alias("date"), F.col("v").alias("sentiment_value"),
                    F.avg("v").over(w.rowsBetween(-2, 0)).alias("ma_3"),
                    F.avg("v").over(w.rowsBetween(-6, 0)).alias("ma_7"))


def _last_day_state(flat: DataFrame, keys) -> DataFrame:
    """Per series: the last grid day with lags, RSI inputs and the OLS slope."""
    g = _grid(flat, keys, "day")
    w = Window.partitionBy(*keys).orderBy("idx")
    g = g.select("*", *[F.lag("v", k).over(w).alias(f"v_{k}") for k in (1, 2, 3, 6, 7)],
                 (F.col("v") - F.lag("v", 1).over(w)).alias("diff"))
    w14 = w.rowsBetween(-13, 0)
    w3 = w.rowsBetween(-2, 0)
    gain = F.greatest(F.col("diff"), F.lit(0.0))
    loss = F.greatest(-F.col("diff"), F.lit(0.0))
    g = g.select("*",
                 F.avg(gain).over(w14).alias("avg_gain"),
                 F.avg(loss).over(w14).alias("avg_loss"),
                 F.count("diff").over(w14).alias("n_diff14"),
                 F.count_if(F.col("diff") > 0).over(w3).alias("up_last3"))
    whole = Window.partitionBy(*keys)
    g = g.select("*",
                 F.regr_slope("v", F.col("idx").cast("double")).over(whole).alias("slope"),
                 F.count("v").over(whole).alias("n_values"),
                 F.max(F.when(F.col("idx") == 0, F.col("v"))).over(whole).alias("v_first"))
    return g.filter(F.col("idx") == F.col("n_buckets") - 1)


def trend_summary(flat: DataFrame, by=None, min_posts: int = 3) -> DataFrame:
    """One row per series with trend, momentum and RSI.

    Evaluated at the last grid day, where ``v[-k]`` is ``lag(v, k-1)``.
    """
    flat, keys, pub = _prep(flat, by)
    t = _last_day_state(flat, keys)
    n = F.col("n_buckets")
    posts = F.col("n_posts")
    v = F.col("v")
    recent = v - F.col("v_2")
    enough = (posts >= min_posts) & (n >= 2)
    direction = (F.when(~enough | (n < 3) | (F.col("n_values") < 2), F.lit("insufficient_data"))
                  .when((F.abs("slope") < 0.05) & (F.abs(recent) < 0.1), F.lit("stable"))
                  .when((F.col("slope") > 0.05) | (recent > 0.1), F.lit("improving"))
                  .otherwise(F.lit("worsening")))
    roc = (F.when(n >= 7, F.try_divide(v - F.col("v_6"), F.col("v_6") + 0.001) * 100)
            .otherwise(F.lit(0.0)))
    rsi = (F.when(n < 14, F.lit(50.0))
            .when(F.col("n_diff14") < 14, F.lit(None).cast("double"))
            .when(F.col("avg_loss") == 0, F.lit(100.0))
            .otherwise(100 - 100 / (1 + F.col("avg_gain") / F.col("avg_loss"))))
    mom = {p: F.when(n > p, v - F.col(f"v_{p}")) for p in (1, 3, 7)}
    mom_sum = (F.when(n > 1, mom[1]).otherwise(F.lit(0.0))
               + F.when(n > 3, mom[3]).otherwise(F.lit(0.0))
               + F.when(n > 7, mom[7]).otherwise(F.lit(0.0)))
    accel = F.when(n >= 3, (v - F.col("v_1")) - (F.col("v_1") - F.col("v_2"))).otherwise(F.lit(0.0))
    momentum_ok = (posts >= 2) & (n >= 2)
    consistency = F.when(n >= 3, F.col("up_last3") / 3.0).otherwise(F.lit(0.5))
    return t.select(
        *pub,
        direction.alias("overall_trend"),
        F.when(enough, F.abs(v - F.col("v_first"))).otherwise(F.lit(0.0)).alias("trend_strength"),
        F.when(enough, F.col("slope")).alias("slope"),
        F.when(enough, roc).alias("rate_of_change"),
        F.when(enough, rsi).alias("rsi"),
        F.when(momentum_ok, mom[1]).alias("momentum_1_day"),
        F.when(momentum_ok, mom[3]).alias("momentum_3_day"),
        F.when(momentum_ok, mom[7]).alias("momentum_7_day"),
        F.when(momentum_ok, accel).alias("acceleration"),
        F.when(momentum_ok, F.when(mom_sum > 0, F.lit("positive")).otherwise(F.lit("negative")))
         .alias("momentum_direction"),
        F.when(posts >= 7, consistency).alias("trend_consistency"),
        n.alias("days"),
    )


def turning_points(flat: DataFrame, by=None, min_posts: int = 3) -> DataFrame:
    """Strict local maxima (peak) and minima (trough) of the daily mean."""
    flat, keys, pub = _prep(flat, by)
    g = _grid(flat, keys, "day").filter((F.col("n_posts") >= min_posts) & (F.col("n_buckets") >= 3))
    w = Window.partitionBy(*keys).orderBy("idx")
    g = g.select(*pub, "bucket", "v", F.lag("v").over(w).alias("prev"), F.lead("v").over(w).alias("next"))
    v = F.col("v")
    kind = (F.when((v > F.col("prev")) & (v > F.col("next")), F.lit("peak"))
             .when((v < F.col("prev")) & (v < F.col("next")), F.lit("trough")))
    return (g.select(*pub, C.date_string("bucket").alias("date"), kind.alias("type"), v.alias("value"))
            .filter(F.col("type").isNotNull()))


def anomalies(flat: DataFrame, by=None, threshold: float = 2.0, min_posts: int = 6) -> DataFrame:
    """Days whose mean sentiment is more than ``threshold`` sample stds off.

    Gap days carry no mean, so only observed days take part; the per-series
    mean and std are windows over the (small) per-day table.
    """
    flat, keys, pub = _prep(flat, by)
    day = (flat.groupBy(*keys, F.to_date("timestamp").alias("day"))
           .agg(F.avg("sentiment_value").alias("v"), F.count(F.lit(1)).alias("post_count"),
                F.sum("engagement_total").alias("engagement_sum")))
    w = Window.partitionBy(*keys)
    day = day.select("*", F.avg("v").over(w).alias("mu"), F.stddev_samp("v").over(w).alias("sd"),
                     F.sum("post_count").over(w).alias("n_posts"))
    z = (F.col("v") - F.col("mu")) / F.col("sd")
    out = (day.filter((F.col("n_posts") >= min_posts) & (F.col("sd") != 0))
              .select(*pub, "day", "v", z.alias("z_score"), "post_count", "engagement_sum")
              .filter(F.abs("z_score") > threshold))
    return out.select(*pub, C.date_string("day").alias("date"), F.col("v").alias("sentiment_value"),
                      "z_score",
                      F.when(F.col("z_score") > 0, F.lit("positive_spike")).otherwise(F.lit("negative_spike"))
                       .alias("type"),
                      "post_count", F.col("engagement_sum").cast("bigint").alias("total_engagement"),
                      F.when(F.abs("z_score") > 3, F.lit("high")).otherwise(F.lit("medium")).alias("severity"))


def _pct_change_vol(g: DataFrame, keys) -> DataFrame:
    """Sample std of bucket-over-bucket relative change (pandas ``pct_change``).

    0/0 changes are dropped; x/0 is infinite, which makes the std undefined.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    g = g.select(*keys, "v", F.lag("v").over(w).alias("prev"))
    both = F.col("v").isNotNull() & F.col("prev").isNotNull()
    r = F.when(both & (F.col("prev") != 0), F.col("v") / F.col("prev") - 1)
    inf = both & (F.col("prev") == 0) & (F.col("v") != 0)
    agg = g.groupBy(*keys).agg(F.stddev_samp(r).alias("sd"), F.count(r).alias("n_r"),
                              F.count_if(inf).alias("n_inf"))
    vol = (F.when(F.col("n_inf") > 0, F.lit(None).cast("double"))
            .when(F.col("n_r") == 0, F.lit(0.0))
            .otherwise(F.col("sd")))
    return agg.select(*keys, vol.alias("vol"))


def volatility(flat: DataFrame, by=None) -> DataFrame:
    """Overall, daily and hourly volatility and the coefficient of variation.

    One aggregate per hour feeds everything: the overall moments, the hourly grid and, summed up, the daily one.
    """
    flat, keys, pub = _prep(flat, by)
    v = F.col("sentiment_value")
    hours = flat.groupBy(*keys, F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"), F.count(v).alias("m"), F.sum(v).alias("s"), F.sum(v * v).alias("sq"))
    empty = [F.lit(None).cast("double").alias(c) for c in ("engagement_sum", "engagement_mean", "engagement_max")]
    per_hour = hours.select(*keys, "bucket", "count", (F.col("s") / F.when(F.col("m") > 0, F.col("m"))).alias("v"), *empty)
    per_day = hours.groupBy(*keys, F.date_trunc("day", "bucket").cast("timestamp_ntz").alias("bucket")).agg(
        F.sum("count").alias("count"), (F.sum("s") / F.nullif(F.sum("m"), F.lit(0))).alias("v")).select(*keys, "bucket", "count", "v", *empty)
    t = hours.groupBy(*keys).agg(F.sum("count").alias("n"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("sq").alias("sq"))
    mean = F.col("s") / F.when(F.col("m") > 0, F.col("m"))
    overall = t.select(*keys, "n", mean.alias("mean"), _std("m", "s", "sq").alias("overall"))
    daily = _pct_change_vol(_grid(flat, keys, "day", per_day), keys).withColumnRenamed("vol", "daily")
    hourly = _pct_change_vol(_grid(flat, keys, "hour", per_hour), keys).withColumnRenamed("vol", "hourly")
    t = beside(keys, overall, daily, hourly)
    small = F.col("n") < 2
    cv = F.when(F.col("mean") != 0, F.col("overall") / F.abs("mean")).otherwise(F.lit(0.0))
    return t.select(*pub,
                    F.when(small, F.lit(0.0)).otherwise(F.col("overall")).alias("overall"),
                    F.when(small, F.lit(0.0)).otherwise(F.col("daily")).alias("daily"),
                    F.when(small, F.lit(0.0)).otherwise(F.col("hourly")).alias("hourly"),
                    F.when(small, F.lit(None).cast("double")).otherwise(cv).alias("coefficient_of_variation"))


def _std(n: str, s: str, sq: str):
    """Sample standard deviation from count, sum and sum of squares (label values are -1, 0, 1, so the sums
    are exact); null below two values."""
    n, s, sq = F.col(n), F.col(s), F.col(sq)
    return F.when(n > 1, F.sqrt(F.greatest((sq - s * s / n) / (n - 1), F.lit(0.0))))


def peak_hours(flat: DataFrame, top: int = 10) -> DataFrame:
    """The busiest hours of the zero-filled hourly grid, earliest first on ties."""
    g = time_grid(flat, "hour")
    return (g.orderBy(F.col("count").desc(), F.col("bucket").asc()).limit(top)
            .select(C.iso_timestamp("bucket").alias("timestamp"), F.col("count").alias("post_count"),
                    F.hour("bucket").cast("bigint").alias("hour_of_day"),
                    C.weekday_name("bucket").alias("day_of_week")))


def peak_summary(flat: DataFrame, by=None) -> DataFrame:
    """Busiest day, mean/max posts per grid hour, share of the 24 busiest hours."""
    flat, keys, pub = _prep(flat, by)
    hours = _grid(flat, keys, "hour")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("count").desc(), F.col("bucket")))
    hour_stats = (hours.select(*keys, "count", rank.alias("rk")).groupBy(*keys)
                  .agg(F.avg("count").alias("avg_posts_per_hour"),
                       F.max("count").alias("max_posts_per_hour"),
                       F.sum(F.when(F.col("rk") <= 24, F.col("count"))).alias("top24"),
                       F.sum("count").alias("total")))
    days = _grid(flat, keys, "day")
    peak = days.groupBy(*keys).agg(
        F.max_by(F.struct("count", "bucket"), F.struct(F.col("count"), -F.col("idx"))).alias("p"))
    t = beside(keys, hour_stats, peak)
    return t.select(*pub, C.date_string("p.bucket").alias("peak_date"),
                    F.col("p.count").alias("peak_day_posts"),
                    C.weekday_name("p.bucket").alias("peak_day_of_week"),
                    "avg_posts_per_hour", F.col("max_posts_per_hour").cast("bigint").alias("max_posts_per_hour"),
                    F.when(F.col("total") > 0, F.col("top24") / F.col("total")).otherwise(F.lit(0.0))
                     .alias("activity_concentration"))


def periodicity(flat: DataFrame, min_posts: int = 24) -> DataFrame:
    """T15 patterns: mean sentiment by hour of day and by weekday (Mon = 0).

    Long form: ``kind`` ∈ {hour, weekday}, ``key``, ``avg_sentiment``; empty
    with fewer than ``min_posts`` posts.  Both patterns come from one
    aggregation keyed by (kind, key) over an exploded pair per post.
    """
    pairs = F.array(F.struct(F.lit("hour").alias("kind"), F.col("hour").cast("bigint").alias("key")),
                    F.struct(F.lit("weekday").alias("kind"),
                             ((F.dayofweek("timestamp") + 5) % 7).cast("bigint").alias("key")))
    e = flat.select("sentiment_value", F.inline(pairs))
    agg = e.groupBy("kind", "key").agg(F.avg("sentiment_value").alias("avg_sentiment"),
                                      F.count(F.lit(1)).alias("n"))
    total = F.sum(F.when(F.col("kind") == "hour", F.col("n"))).over(Window.partitionBy())
    return (agg.select("kind", "key", "avg_sentiment", total.alias("n_posts"))
               .filter(F.col("n_posts") >= min_posts).drop("n_posts"))


def periodicity_summary(flat: DataFrame, min_posts: int = 24) -> DataFrame:
    """T15 summary: pattern strength (sample variance), best and worst key."""
    p = periodicity(flat, min_posts)
    a, k = F.col("avg_sentiment"), F.col("key")
    return p.groupBy("kind").agg(
        F.var_samp(a).alias("strength"),
        F.min_by(k, F.struct(-a, k)).alias("most_positive"),
        F.min_by(k, F.struct(a, k)).alias("most_negative"))


def recent_distribution(flat: DataFrame, days: int = 3, min_posts: int = 7) -> DataFrame:
    """Label shares among posts within ``days`` of the latest post."""
    w = Window.partitionBy()
    stats = flat.agg(F.max("timestamp").alias("mx"), F.count(F.lit(1)).alias("n"))
    cutoff = stats.select(F.col("mx") - F.expr(f"INTERVAL {int(days)} DAYS")).scalar()
    n = stats.select("n").scalar()
    recent = flat.filter((F.col("timestamp") >= cutoff) & (n >= min_posts))
    counts = recent.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("sentiment", (F.col("n") / F.sum("n").over(w)).alias("share"))


def time_rank(flat: DataFrame) -> DataFrame:
    """0-based rank of every post in (timestamp, seq) order, without one-task sorts.

    A global ``orderBy`` range-partitions on the unique key (balanced even
    when one timestamp is hot); per-partition row counts (one row per
    partition) give each partition's offset.  The sorted frame is
    checkpointed so ids and offsets come from the same physical run.
    """
    sorted_ = (flat.select("timestamp", "seq", "sentiment_value")
                   .orderBy("timestamp", "seq")
                   .withColumn("mid", F.monotonically_increasing_id()))
    sorted_ = sorted_.checkpoint(eager=True)
    part = F.shiftright("mid", 33)
    local = F.col("mid") - F.shiftleft(part, 33)
    counts = sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    ranked = sorted_.join(F.broadcast(offsets), part == offsets.part)  # one row per partition
    return ranked.select("timestamp", "seq", "sentiment_value", (F.col("offset") + local).alias("rank"))


def forecast_indicators(flat: DataFrame, min_posts: int = 7, split_min_posts: int = 14) -> DataFrame:
    """One row (empty with fewer than ``min_posts`` posts).

    ``volatility_trend`` compares the sample std of the first ``n // 2``
    posts in time order with the rest (T18): hours are summed, and only the posts of the hour that
    holds the middle are ranked (:func:`time_rank`).
    """
    flat, keys, _ = _prep(flat, None)
    v = F.col("sentiment_value")
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz")
    moments = (F.count(F.lit(1)).alias("c"), F.count(v).alias("m"), F.sum(v).alias("s"), F.sum(v * v).alias("sq"))
    hours = flat.groupBy(hour.alias("hour")).agg(*moments, F.max_by(F.struct("sentiment_value", "timestamp"),
                                                                    F.struct("timestamp", "seq")).alias("last"))
    every = Window.partitionBy(F.lit(0))  # one row per hour of the data
    hours = (hours.withColumn("n", F.sum("c").over(every))
             .withColumn("before", F.sum("c").over(every.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")))
    half = F.floor(F.col("n") / 2)
    hours = hours.withColumn("side", F.when(F.col("before") + F.col("c") <= half, F.lit(1)).when(F.col("before") >= half, F.lit(2))
                             .otherwise(F.lit(0)))
    # only the hour that holds the middle is ranked post by post
    middle = hours.filter("side = 0").select("hour").scalar()
    skip = hours.filter("side = 0").select((F.floor(F.col("n") / 2) - F.col("before")).alias("k")).scalar()
    inside = time_rank(flat.filter(hour == middle))
    cut = inside.groupBy(F.when(F.col("rank") < skip, F.lit(1)).otherwise(F.lit(2)).alias("side")).agg(*moments)
    sides = hours.filter("side <> 0").select("side", "m", "s", "sq").unionByName(cut.select("side", "m", "s", "sq"))
    sides = sides.groupBy("side").agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("sq").alias("sq"))
    sides = sides.select("side", _std("m", "s", "sq").alias("sd"))
    halves = sides.agg(F.max(F.when(F.col("side") == 1, F.col("sd"))).alias("s1"), F.max(F.when(F.col("side") == 2, F.col("sd"))).alias("s2"))
    ends = hours.agg(F.sum("c").alias("n"), F.max_by("last", "hour").alias("last"))
    trend = trend_summary(flat.drop(SERIES)).select("trend_consistency")
    t = beside(keys, *[f.withColumn(SERIES, F.lit(0)) for f in (ends, halves, trend)])
    vt = (F.when(F.col("n") < split_min_posts, F.lit("unknown"))
           .when(F.col("s2") > F.col("s1"), F.lit("increasing"))
           .otherwise(F.lit("decreasing")))
    return (t.filter(F.col("n") >= min_posts)
             .select("trend_consistency", vt.alias("volatility_trend"),
                     F.col("last.sentiment_value").alias("last_sentiment_value"),
                     C.iso_timestamp("last.timestamp").alias("last_update")))


def timeline_percent(flat: DataFrame) -> DataFrame:
    """Per day positive/negative/neutral share in percent, plus volume."""
    d = daily_sentiment(flat)
    pct = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(F.lit(0.0))  # noqa
    return d.select("date", pct("positive").alias("positive_pct"), pct("negative").alias("negative_pct"),
                    pct("neutral").alias("neutral_pct"), F.col("total").alias("volume"),
                    "sentiment_ratio")
