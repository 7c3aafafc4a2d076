"""Export tables and sinks.

Every export is a projection of posts or of an analysis result; sinks are
Spark writers (JSON lines, CSV with header, parquet).  Nothing is gathered
on the driver: large tables are written by the executors, small one-row
results are serialised with ``to_json`` inside the job.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.functions import columns as C
from chorus.operators import aggregate as A
from chorus.operators import series as S
from chorus.operators.project import posts_flat
from chorus.sources.document import write_document
from chorus.session import ensure_checkpoint_dir

CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss"


def export_posts(posts: DataFrame) -> DataFrame:
    """The 22-column post table (missing sentiment → '', 0, '')."""
    sent = F.col("sentiment")
    md = F.col("metadata")
    e = F.col("engagement")
    size0 = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    has_e = F.coalesce(F.size(e), F.lit(0)) > 0
    return posts.select(
        "id", "platform", "author", "author_id",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").alias("timestamp"),
        F.to_date("timestamp").alias("date"), F.hour("timestamp").cast("bigint").alias("hour"),
        "query", "url",
        C.truncate_strip("content", 500).alias("content"),
        F.char_length(F.coalesce("content", F.lit(""))).cast("bigint").alias("content_length"),
        F.when(F.length("title") > 0, C.truncate_strip("title", 200)).otherwise(F.lit("")).alias("title"),
        F.when(sent.isNull(), F.lit("")).otherwise(F.coalesce(sent["label"], F.lit(""))).alias("sentiment"),
        F.when(sent.isNull(), F.lit(0.0)).otherwise(F.coalesce(sent["score"], F.lit(0.0))).alias("sentiment_score"),
        F.when(sent.isNull(), F.lit("")).otherwise(F.coalesce(sent["method"], F.lit(""))).alias("sentiment_method"),
        F.when(has_e, C.likes()).otherwise(F.lit(0.0)).alias("likes"),
        F.when(has_e, C.shares()).otherwise(F.lit(0.0)).alias("shares"),
        F.when(has_e, C.replies()).otherwise(F.lit(0.0)).alias("replies"),
        C.engagement_total().alias("engagement_total"),
        size0(md["hashtags"]).alias("hashtag_count"), size0(md["mentions"]).alias("mention_count"),
        (size0(md["media_types"]) > 0).alias("has_media"))


def export_daily_statistics(flat: DataFrame) -> DataFrame:
    """Daily sentiment with the export's column names."""
    d = S.daily_sentiment(flat)
    return d.select("date", F.col("total").alias("total_posts"), "positive", "negative", "neutral",
                    "sentiment_ratio", "positive_ratio", F.col("avg_sentiment").alias("avg_sentiment_score"),
                    "total_engagement", "avg_engagement", "unique_authors")


def _written(df: DataFrame) -> DataFrame:
    """``df`` evaluated once and written to the checkpoint folder, for several readers."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def export_summary_statistics(flat: DataFrame) -> DataFrame:
    """Long ``(metric, value, category)`` table of the headline numbers.

    The posts are read once, into counts and sums per label and author; every metric is read from those.
    """
    cells = _written(flat.groupBy("sentiment", "author").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
        *[F.sum(c).alias(c) for c in ("likes", "shares", "engagement_total")],
        F.count("engagement_total").alias("n_engagement"), F.max("engagement_total").alias("max_engagement")))
    base = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_posts"), F.countDistinct("author").alias("unique_authors"),
                     F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                     F.sum("likes").alias("total_likes"), F.sum("shares").alias("total_shares"),
                     F.try_divide(F.sum("engagement_total"), F.sum("n_engagement")).alias("avg_engagement"),
                     F.max("max_engagement").alias("max_engagement"))
    diff_us = C.micros_between("lo", "hi")
    days = (F.floor(diff_us / F.lit(86_400_000_000)) + 1).cast("double")
    general = base.select(F.stack(
        F.lit(3), F.lit("total_posts"), F.col("total_posts").cast("double"), F.lit("general"),
        F.lit("unique_authors"), F.col("unique_authors").cast("double"), F.lit("general"),
        F.lit("date_range_days"), days, F.lit("general")).alias("metric", "value", "category"))
    engagement = base.select(F.stack(
        F.lit(4), F.lit("total_likes"), F.floor("total_likes").cast("double"), F.lit("engagement"),
        F.lit("total_shares"), F.floor("total_shares").cast("double"), F.lit("engagement"),
        F.lit("avg_engagement"), F.col("avg_engagement"), F.lit("engagement"),
        F.lit("max_engagement"), F.floor("max_engagement").cast("double"), F.lit("engagement"))
        .alias("metric", "value", "category"))
    per_label = cells.groupBy("sentiment").agg(F.sum("n").alias("count"))
    counts = per_label.select(
        F.concat(F.lit("sentiment_"), F.lower("sentiment")).alias("metric"), F.col("count").cast("double").alias("value"),
        F.lit("sentiment").alias("category"))
    ratio = A.label_summary(per_label).select(F.lit("sentiment_ratio").alias("metric"),
                                              F.col("sentiment_ratio").alias("value"), F.lit("sentiment").alias("category"))
    return general.unionByName(counts).unionByName(ratio).unionByName(engagement)


def export_negative_users(flat: DataFrame) -> DataFrame:
    """Negative users table."""
    return A.negative_users(flat)


def export_viral_posts(flat: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Viral posts table, most engaging first."""
    return A.viral_posts(flat, posts)


def export_hashtags(posts: DataFrame) -> DataFrame:
    """Top hashtags as (hashtag, count)."""
    return A.top_terms(posts, "hashtags").select(F.col("term").alias("hashtag"), "count")


def export_anomalies(flat: DataFrame) -> DataFrame:
    """Anomaly table."""
    return S.anomalies(flat).select("date", "type", "z_score", "severity", "post_count", "sentiment_value")


def hourly_activity(flat: DataFrame) -> DataFrame:
    """Posts for each of the 24 hours, zero-filled (24-row dimension)."""
    hours = flat.sparkSession.range(24).select(F.col("id").alias("hour"))
    counts = A.posts_by_hour(flat)
    return F.broadcast(hours).join(counts, "hour", "left").select("hour", F.coalesce("count", F.lit(0)).alias("count"))


def chart_tables(flat: DataFrame, posts: DataFrame) -> dict[str, DataFrame]:
    """Data behind the report charts."""
    return {
        "sentiment_pie": A.count_by(flat, "sentiment"),
        "sentiment_timeline": S.daily_sentiment(flat).select("date", "positive", "negative", "neutral",
                                                            "total_engagement", "sentiment_ratio"),
        "hourly_activity": hourly_activity(flat),
        "platform_comparison": A.by_platform(flat),
        "top_hashtags": A.top_terms(posts, "hashtags", 10),
        "sentiment_bar": A.count_by(flat, "sentiment"),
    }


def report_cuts(results: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The report's list lengths (limits are the feature), each list in its own order first."""
    cut = {"negative_users": (20, [F.desc("negative_ratio"), "author"]), "viral_posts": (10, [F.desc("engagement"), "id"]),
           "ts_anomalies": (10, [F.desc(F.abs("z_score")), "date"]), "top_hashtags": (20, [F.desc("count"), "term"]),
           "most_active_authors": (10, [F.desc("posts"), "author"])}
    return {k: results[k].orderBy(*order).limit(n) for k, (n, order) in cut.items() if k in results}


def report_header(flat: DataFrame) -> DataFrame:
    """Formatted headline numbers and the human date range."""
    t = flat.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author").alias("authors"),
                 F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    diff_us = C.micros_between("lo", "hi")
    days = F.floor(diff_us / F.lit(86_400_000_000)) + 1
    return t.select(C.format_count(F.col("n").cast("double")).alias("total_posts"),
                    C.format_count(F.col("authors").cast("double")).alias("unique_authors"),
                    C.date_range_label("lo", "hi", days.cast("bigint")).alias("date_range"))


def dashboard_rows(posts: DataFrame) -> DataFrame:
    """The dashboard's 9-column post table."""
    return posts.select("author", F.col("metadata.subreddit").alias("subreddit"), F.col("query").alias("topic"),
                        F.col("sentiment.label").alias("sentiment"), F.col("sentiment.score").alias("score"),
                        "title", "content", "url", "timestamp")


def summary_document(flat: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """The summary in one row, a column per leaf.

    ``flags`` are the dedup flags of the posts (``processing_summary``).  The posts are read once: the columns
    the parts need are written as a narrow table, which all of them read.  Every part is a one-row
    aggregate; they are put side by side on a constant key, the top-3 negative users as text.
    """
    key = "_one"
    flat = _written(flat.select("seq", "id", "platform", "author", "timestamp", "sentiment", "sentiment_score", "sentiment_value",
                                "engagement_total", "likes", "shares"))
    lab = F.col("sentiment")
    total = F.count(F.lit(1))
    counts = [F.count_if(lab == x).alias(x.lower()) for x in (*A.LABELS, "UNKNOWN")]
    shares = [(F.count_if(lab == x) / total * 100).alias(f"{x.lower()}_percent") for x in (*A.LABELS, "UNKNOWN")]
    base = flat.agg(total.alias("total_posts"), F.countDistinct("author").alias("unique_authors"),
                    *counts, *shares, F.sum("engagement_total").cast("bigint").alias("total_engagement"),
                    F.avg("engagement_total").alias("avg_engagement"))
    neg = A.negative_users(flat)
    top3 = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(
        -F.col("negative_ratio"), F.col("author"), F.col("post_count")))), 1, 3), lambda u: F.concat_ws(":", u["author"], u["post_count"])), "|")
    parts = [base,
             A.date_range(flat).select(F.col("days").alias("date_range_days")),
             A.sentiment_summary(flat).select("sentiment_ratio", "dominant_sentiment"),
             A.viral_posts(flat.withColumn("content", F.lit("")).withColumn("url", F.lit(""))).agg(total.alias("viral_posts_count")),
             S.trend_summary(flat).select("overall_trend", "trend_strength"),
             S.volatility(flat).select(F.col("overall").alias("volatility")),
             S.anomalies(flat).agg(total.alias("anomalies_count")),
             neg.agg(total.alias("negative_users_count"), top3.alias("negative_users_top_3"))]
    if flags is not None:
        parts.append(flags.agg(total.alias("dedup_total"), F.count_if("kept").alias("dedup_unique"),
                               F.count_if(~F.col("kept")).alias("dedup_removed")))
    return S.beside([key], *[p.withColumn(key, F.lit(0)) for p in parts]).drop(key)


# ---------------------------------------------------------------------------- sinks

def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, UTF-8, keys in sorted order."""
    df.select(*sorted(df.columns)).write.mode(mode).option("encoding", "UTF-8").json(path)


def write_csv(tables: dict[str, DataFrame], prefix: str, mode: str = "overwrite") -> list[str]:
    """One CSV folder per non-empty table, with header and ``%Y-%m-%d %H:%M:%S`` timestamps."""
    written = []
    for name, df in tables.items():
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)  # evaluated once for the emptiness test and the write
        if df.isEmpty():
            continue
        path = f"{prefix}_{name}"
        flat_cols = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct")
                     else F.col(f.name) for f in df.schema.fields]
        (df.select(*flat_cols).write.mode(mode).option("header", True)
           .option("timestampFormat", CSV_TIMESTAMP).option("timestampNTZFormat", CSV_TIMESTAMP).csv(path))
        written.append(path)
    return written


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_analysis(results: dict[str, DataFrame], posts: DataFrame, path: str, context: dict | None = None) -> None:
    """E5: the analysis document as folders: ``metadata/`` and ``summary/`` (one row each), ``posts/`` (JSON
    lines, read back by ``read_analysis_posts``) and one JSON-lines folder per result table."""
    spark = posts.sparkSession
    context = context or {}
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    write_json(spark.range(1).select(now.alias("generated_at"), F.lit(context.get("version", "1.0.0")).alias("version"),
                                     F.lit(json.dumps(context.get("queries", []))).alias("queries"),
                                     F.lit(int(context.get("time_window_days", 0))).alias("time_window_days"),
                                     F.lit(json.dumps(context.get("platforms", []))).alias("platforms")), f"{path}/metadata")
    write_json(posts.agg(F.count(F.lit(1)).alias("total_posts"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end")),
               f"{path}/summary")
    write_json(posts, f"{path}/posts")
    for name, df in results.items():
        write_json(df, f"{path}/{name}")


def write_analysis_document(results: dict[str, DataFrame], posts: DataFrame, path: str, context: dict | None = None) -> None:
    """E5 as the one JSON document: ``metadata``, ``posts`` (in ``seq`` order) and an array per result table."""
    context = context or {}
    metadata = {"version": context.get("version", "1.0.0"), "queries": context.get("queries", []),
                "time_window_days": int(context.get("time_window_days", 0)), "platforms": context.get("platforms", [])}
    write_document(path, {"metadata": metadata, "posts": posts, **results})


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str, document: bool = False) -> None:
    """Node-link export as two JSON-lines folders (``nodes``, ``links``), or as one document."""
    if document:
        links = edges.withColumnRenamed("src", "source").withColumnRenamed("dst", "target")
        return write_document(path, {"directed": True, "multigraph": False, "nodes": nodes, "links": links})
    write_json(nodes, f"{path}/nodes")
    write_json(edges.withColumnRenamed("src", "source").withColumnRenamed("dst", "target"), f"{path}/links")


__all__ = ["export_posts", "export_daily_statistics", "export_summary_statistics", "export_negative_users",
           "export_viral_posts", "export_hashtags", "export_anomalies", "hourly_activity", "chart_tables", "report_cuts",
           "report_header", "dashboard_rows", "summary_document", "write_json", "write_csv", "write_parquet",
           "write_analysis", "write_analysis_document", "write_node_link", "posts_flat"]
