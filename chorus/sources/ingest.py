"""Sources: landed platform JSON → posts.

HTTP scraping is not rebuilt; its output (tweets, reddit submissions,
listing pages, comments, exported analyses) is read as JSON with explicit
schemas, so nothing is inferred and parsing stays in the JVM.  Each mapping
is one ``select`` and takes either a file path (``read_*``) or an already
parsed DataFrame (``*_to_posts``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.functions import text as X
from chorus.functions.columns import ntz_from_epoch_seconds
from chorus.schema import POST_COLUMNS, engagement_map, landed, landed_files, metadata_struct
from chorus.sources.document import numbered, read_document

S = T.StringType()
L = T.LongType()
B = T.BooleanType()
D = T.DoubleType()

TWEET_SCHEMA = T.StructType([
    T.StructField("id", S), T.StructField("date", T.TimestampNTZType()),
    T.StructField("user", T.StructType([T.StructField("username", S), T.StructField("id", S)])),
    T.StructField("rawContent", S),
    T.StructField("likeCount", L), T.StructField("retweetCount", L),
    T.StructField("replyCount", L), T.StructField("quoteCount", L),
    T.StructField("url", S), T.StructField("lang", S),
    T.StructField("hashtags", T.ArrayType(T.StructType([T.StructField("text", S)]))),
    T.StructField("mentionedUsers", T.ArrayType(T.StructType([T.StructField("username", S)]))),
    T.StructField("outlinks", T.ArrayType(S)),
    T.StructField("media", T.ArrayType(T.StructType([T.StructField("type", S)]))),
    T.StructField("coordinates", T.StructType([T.StructField("latitude", D), T.StructField("longitude", D)])),
    T.StructField("retweetedTweet", T.StructType([T.StructField("id", S)])),
    T.StructField("quotedTweet", T.StructType([T.StructField("id", S)])),
    T.StructField("inReplyToTweetId", S),
])

SUBMISSION_FIELDS = [
    ("id", S), ("title", S), ("selftext", S), ("author", S), ("author_fullname", S), ("permalink", S),
    ("subreddit", S), ("subreddit_id", S), ("domain", S), ("link_flair_text", S), ("author_flair_text", S),
    ("created_utc", D), ("score", L), ("ups", L), ("downs", L), ("num_comments", L), ("upvote_ratio", D),
    ("num_crossposts", L), ("is_self", B), ("is_video", B), ("is_original_content", B), ("over_18", B),
    ("spoiler", B), ("stickied", B), ("locked", B),
]
SUBMISSION_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in SUBMISSION_FIELDS]
    + [T.StructField("all_awardings", T.ArrayType(T.StructType([T.StructField("id", S)])))])

LISTING_SCHEMA = T.StructType([T.StructField("data", T.StructType([
    T.StructField("children", T.ArrayType(T.StructType([T.StructField("data", SUBMISSION_SCHEMA)])))]))])

COMMENT_SCHEMA = T.StructType([
    T.StructField("id", S), T.StructField("author", S), T.StructField("body", S), T.StructField("score", L),
    T.StructField("created_utc", D), T.StructField("is_submitter", B), T.StructField("parent_id", S),
    T.StructField("permalink", S), T.StructField("submission_id", S), T.StructField("position", L),
])


def _ordered(raw: DataFrame, seq: Column | None):
    return (raw, seq) if seq is not None else (landed(raw), F.col("seq"))


def tweets_to_posts(raw: DataFrame, query, seq: Column | None = None) -> DataFrame:
    """Raw tweet rows → posts.  ``query`` is a column name or a literal; without
    ``seq`` the rows are landed first, which fixes their order."""
    raw, seq = _ordered(raw, seq)
    q = F.col(query) if isinstance(query, str) and query in raw.columns else F.lit(query)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    content = F.coalesce(F.col("rawContent"), F.lit(""))
    tags = F.transform("hashtags", lambda h: h["text"])
    users = F.transform(F.filter("mentionedUsers", lambda u: u["username"].isNotNull()), lambda u: u["username"])
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    metadata = metadata_struct(
        lang=F.col("lang"),
        hashtags=F.when(has("hashtags"), tags).otherwise(X.hashtags_from_text(content)),
        mentions=F.when(has("mentionedUsers"), users).otherwise(X.mentions_from_text(content)),
        urls=F.when(has("outlinks"), F.col("outlinks")).otherwise(X.urls_from_text(content)),
        is_retweet=F.col("retweetedTweet").isNotNull(),
        is_quote=F.col("quotedTweet").isNotNull(),
        is_reply=F.coalesce(F.length("inReplyToTweetId") > 0, F.lit(False)),
        media_types=F.coalesce(F.transform("media", lambda m: m["type"]), F.array().cast("array<string>")),
        coordinates=F.when(F.col("coordinates").isNotNull(),
                           F.struct(F.col("coordinates.latitude").alias("lat"),
                                    F.col("coordinates.longitude").alias("lon"))),
    )
    return raw.select(
        seq.cast("bigint").alias("seq"),
        F.col("id").cast("string").alias("id"),
        F.lit("twitter").alias("platform"),
        F.when(F.col("user").isNotNull(), F.col("user.username")).otherwise(F.lit("unknown")).alias("author"),
        F.col("user.id").cast("string").alias("author_id"),
        content.alias("content"),
        F.lit(None).cast("string").alias("title"),
        F.col("date").cast("timestamp_ntz").alias("timestamp"),
        engagement_map(likes=z("likeCount"), retweets=z("retweetCount"),
                       replies=z("replyCount"), quotes=z("quoteCount")).alias("engagement"),
        F.coalesce(F.col("url"), F.concat(F.lit("https://twitter.com/i/status/"), F.col("id"))).alias("url"),
        q.alias("query"),
        metadata.alias("metadata"),
        F.lit(None).cast("struct<label:string,score:double,method:string,compound:double,"
                         "original_text:string,details:map<string,double>>").alias("sentiment"),
    )


def _reddit_metadata(listing: bool) -> Column:
    d = (lambda c, v: F.coalesce(F.col(c), F.lit(v))) if listing else (lambda c, v: F.col(c))
    return metadata_struct(
        subreddit=d("subreddit", ""), subreddit_id=d("subreddit_id", ""), is_self=d("is_self", False),
        is_video=d("is_video", False), is_original_content=F.coalesce(F.col("is_original_content"), F.lit(False)),
        over_18=d("over_18", False), spoiler=d("spoiler", False), stickied=d("stickied", False),
        locked=d("locked", False), num_crossposts=F.coalesce(F.col("num_crossposts"), F.lit(0)),
        awards=F.coalesce(F.size("all_awardings"), F.lit(0)).cast("bigint"),
        domain=d("domain", ""), link_flair_text=d("link_flair_text", ""),
        author_flair_text=d("author_flair_text", ""))


def _reddit_post(raw: DataFrame, engagement: Column, author: Column, query, seq,
                 listing: bool = False) -> DataFrame:
    raw, seq = _ordered(raw, seq)
    q = F.col(query) if isinstance(query, str) and query in raw.columns else F.lit(query)
    return raw.select(
        seq.cast("bigint").alias("seq"),
        F.coalesce(F.col("id"), F.lit("")).alias("id"),
        F.lit("reddit").alias("platform"),
        author.alias("author"),
        F.col("author_fullname").alias("author_id"),
        F.coalesce(F.col("selftext"), F.lit("")).alias("content"),
        F.col("title"),
        ntz_from_epoch_seconds(F.coalesce(F.col("created_utc"), F.lit(0.0))).alias("timestamp"),
        engagement.alias("engagement"),
        F.concat(F.lit("https://reddit.com"), F.coalesce(F.col("permalink"), F.lit(""))).alias("url"),
        q.alias("query"),
        _reddit_metadata(listing).alias("metadata"),
        F.lit(None).cast("struct<label:string,score:double,method:string,compound:double,"
                         "original_text:string,details:map<string,double>>").alias("sentiment"),
    )


def submissions_to_posts(raw: DataFrame, query, seq: Column | None = None) -> DataFrame:
    """Reddit submissions → posts.  Up/down votes derive from score and
    ratio (truncated like ``int()``); ratio 0/null → upvotes = score."""
    score = F.col("score").cast("double")
    ratio = F.col("upvote_ratio")
    has_ratio = F.coalesce(ratio != 0, F.lit(False))
    engagement = engagement_map(
        score=score,
        upvotes=F.when(has_ratio, (score * ratio).cast("bigint")).otherwise(F.col("score")),
        downvotes=F.when(has_ratio, (score * (1 - ratio)).cast("bigint")).otherwise(F.lit(0)),
        num_comments=F.col("num_comments"),
        upvote_ratio=ratio)
    author = F.coalesce(F.col("author"), F.lit("[deleted]"))
    return _reddit_post(raw, engagement, author, query, seq)


def listing_to_posts(listing: DataFrame, query, seq: Column | None = None) -> DataFrame:
    """S3: listing pages (``data.children[].data``) → posts, with the JSON API defaults."""
    rows = listing.select(*[c for c in listing.columns if c != "data"],
                          F.explode("data.children").alias("child")).select("*", "child.data.*").drop("child")
    rows = rows.filter(F.col("id").isNotNull())  # malformed children are skipped
    engagement = engagement_map(
        score=F.coalesce(F.col("score"), F.lit(0)), upvotes=F.coalesce(F.col("ups"), F.lit(0)),
        downvotes=F.coalesce(F.col("downs"), F.lit(0)), num_comments=F.coalesce(F.col("num_comments"), F.lit(0)),
        upvote_ratio=F.coalesce(F.col("upvote_ratio"), F.lit(0.5)))
    return _reddit_post(rows, engagement, F.coalesce(F.col("author"), F.lit("[deleted]")), query, seq,
                        listing=True)


def comments_to_rows(raw: DataFrame, limit: int = 100, bad_records: list | None = None) -> DataFrame:
    """Comments → flat rows, the first ``limit`` per submission in listing order.

    The submission is ``submission_id`` where the landed row has one, else the id in its permalink
    (``/comments/<id>/``), else a ``t3_`` parent.  A row that none of them places raises an error; with
    ``bad_records=[]`` such rows are left out and received as the frame ``bad_records[0]`` instead.  Without ``position`` the order of the input decides.
    """
    for name in ("submission_id", "position", "parent_id", "permalink"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("bigint" if name == "position" else "string"))
    raw = landed(raw)
    link = F.nullif(F.regexp_extract(F.coalesce("permalink", F.lit("")), "/comments/([^/]+)", 1), F.lit(""))
    parent = F.nullif(F.regexp_extract(F.coalesce("parent_id", F.lit("")), "^t3_(.+)$", 1), F.lit(""))
    placed = F.coalesce("submission_id", link, parent)
    if bad_records is not None:
        bad_records.append(raw.where(placed.isNull()).drop("seq"))
        raw = raw.where(placed.isNotNull())
    lost = F.raise_error(F.concat(F.lit("comment without a submission: "), F.coalesce(F.col("id"), F.lit("null")))).cast("string")
    raw = raw.withColumn("submission_id", F.coalesce(placed, lost))
    rk = F.row_number().over(Window.partitionBy("submission_id").orderBy("position", "seq"))
    return (raw.select("*", rk.alias("rk")).filter(F.col("rk") <= limit)
            .select("id", F.coalesce("author", F.lit("[deleted]")).alias("author"), "body", "score",
                    ntz_from_epoch_seconds(F.col("created_utc")).alias("created_utc"),
                    "is_submitter", "parent_id",
                    F.concat(F.lit("https://reddit.com"), F.col("permalink")).alias("permalink"),
                    "submission_id"))


def _read(df: DataFrame) -> DataFrame:
    """Rows of files, numbered in (file path, position) order; made once, so later plans agree."""
    return landed_files(df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block")))


def read_tweets(spark: SparkSession, path: str, query) -> DataFrame:
    return tweets_to_posts(_read(spark.read.schema(TWEET_SCHEMA).json(path)), query, F.col("seq"))


def read_submissions(spark: SparkSession, path: str, query) -> DataFrame:
    return submissions_to_posts(_read(spark.read.schema(SUBMISSION_SCHEMA).json(path)), query, F.col("seq"))


def read_listings(spark: SparkSession, path: str, query, bad_records: list | None = None) -> DataFrame:
    """S3 from files.  Malformed lines are kept in ``_corrupt_record`` (PERMISSIVE
    mode) instead of failing the job; pass ``bad_records=[]`` to receive that
    frame as ``bad_records[0]``."""
    schema = T.StructType(LISTING_SCHEMA.fields + [T.StructField("_corrupt_record", S)])
    raw = (spark.read.schema(schema).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    if bad_records is not None:
        # the filter also reads a parsed column (null on malformed lines), so no
        # plan ever scans the corrupt-record column alone, which Spark rejects
        bad_records.append(raw.filter(F.col("_corrupt_record").isNotNull() & F.col("data").isNull())
                           .select("_corrupt_record"))
    return listing_to_posts(raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), query)


def read_comments(spark: SparkSession, path: str, limit: int = 100, bad_records: list | None = None) -> DataFrame:
    return comments_to_rows(spark.read.schema(COMMENT_SCHEMA).json(path), limit, bad_records)


def read_analysis_posts(spark: SparkSession, path: str, post_schema: T.StructType) -> DataFrame:
    """Posts of an exported analysis document (``{"posts": [...]}`` or a bare list).

    A missing file yields an empty frame with the schema.  ``path`` may be on any file system Spark
    reads; a folder written by ``write_analysis`` is read from its ``posts`` part.  One document is split at its
    objects' borders (``chorus.sources.document``), so many tasks share it.  Where no row has a ``seq``, rows
    are numbered in document order.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], post_schema)
    inner = f"{path.rstrip('/')}/posts"
    if path_exists(spark, inner):
        return _numbered(spark.read.schema(post_schema).json(inner), post_schema)
    if not _is_folder(spark, path):
        rows = read_document(spark, path, {"posts": post_schema})["posts"]
        return (numbered(rows) if "seq" in post_schema.fieldNames() else rows).select(*post_schema.fieldNames())
    wide = T.StructType([T.StructField("posts", T.ArrayType(post_schema)), *post_schema.fields])
    doc = spark.read.schema(wide).option("multiLine", True).json(path)  # a bare list gives one row per post
    own = F.array(F.struct(*[F.col(c) for c in post_schema.fieldNames()]))
    some = F.greatest(*[F.col(c).isNotNull().cast("int") for c in post_schema.fieldNames()]) > 0
    rows = doc.select(F.explode(F.when(F.col("posts").isNotNull(), F.col("posts")).when(some, own)).alias("p")).select("p.*")
    return _numbered(rows, post_schema)


def _numbered(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the schema's columns; when none carries ``seq`` they are numbered in input order."""
    if "seq" not in schema.fieldNames():
        return rows
    if not rows.filter(F.col("seq").isNull()).isEmpty():
        rows = landed(rows.drop("seq"))
    return rows.select(*schema.fieldNames())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system holds ``path``."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()


def read_graph(spark: SparkSession, path: str, node_schema: T.StructType | None = None, link_schema: T.StructType | None = None):
    """Node-link JSON → (nodes, edges) DataFrames.

    With schemas (``source`` and ``target`` among the links' fields) attributes are typed columns; without, a document's
    attributes are a map of strings.

    Reads a single node-link document (``{"nodes": [...], "links": [...]}``)
    or the split form written by ``chorus.plans.export.write_node_link``
    (``nodes/`` and ``links/`` JSON-lines folders).
    """
    path = path.rstrip("/")
    if path_exists(spark, f"{path}/nodes"):
        nodes = spark.read.json(f"{path}/nodes")
        links = spark.read.json(f"{path}/links")
        return nodes, links.withColumnRenamed("source", "src").withColumnRenamed("target", "dst")
    attrs = T.MapType(S, S)
    doc = read_document(spark, path, {"nodes": node_schema or attrs, "links": link_schema or attrs})
    nodes, edges = doc["nodes"].drop("_place"), doc["links"].drop("_place")
    if node_schema is None:
        nodes = nodes.select(F.col("e")["id"].alias("id"), F.col("e").alias("attrs"))
    if link_schema is None:
        return nodes, edges.select(F.col("e")["source"].alias("src"), F.col("e")["target"].alias("dst"),
                                   F.col("e")["weight"].cast("double").alias("weight"), F.col("e").alias("attrs"))
    return nodes, edges.withColumnRenamed("source", "src").withColumnRenamed("target", "dst")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Concatenate post frames (no distinct), filling missing columns with nulls.

    ``seq`` stays unique and keeps the order of the frames and the order inside each: a frame's numbers are moved
    behind the span of the frames before it (one narrow scan of ``seq`` finds the spans).  So unions can be united
    again, with any number of sources; only spans of more than 2**63 in all are an error.
    """
    spans = reduce(DataFrame.unionByName, [f.select(F.lit(i).alias("frame"), "seq") for i, f in enumerate(frames)])
    spans = {r["frame"]: (r["low"], r["high"]) for r in spans.groupBy("frame").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).collect()}
    moved, start = [], 0
    for i, f in enumerate(frames):
        low, high = spans.get(i, (0, -1))
        if start + high - low >= 1 << 63:
            raise OverflowError("the sources' numbers span more than 2**63")
        moved.append(f.withColumn("seq", F.col("seq") - F.lit(low) + F.lit(start)) if start != low else f)
        start += high - low + 1
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), moved).select(*POST_COLUMNS)


def collection_stats(posts: DataFrame) -> DataFrame:
    """Per platform — posts, distinct queries, posts per query."""
    return posts.groupBy("platform").agg(
        F.count(F.lit(1)).alias("posts"), F.countDistinct("query").alias("queries"),
        (F.count(F.lit(1)) / F.countDistinct("query")).alias("posts_per_query"))


def collection_by_query(posts: DataFrame) -> DataFrame:
    """Posts per (platform, query)."""
    return posts.groupBy("platform", "query").agg(F.count(F.lit(1)).alias("posts"))


def with_entities(posts: DataFrame) -> DataFrame:
    """hashtags/mentions from metadata when present, else from the text; URLs likewise."""
    md = F.col("metadata")
    content = F.coalesce(F.col("content"), F.lit(""))
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return posts.withColumn("metadata", md.withField(
        "hashtags", F.when(has(md["hashtags"]), md["hashtags"]).otherwise(X.hashtags_from_text(content))
    ).withField(
        "mentions", F.when(has(md["mentions"]), md["mentions"]).otherwise(X.mentions_from_text(content))
    ).withField(
        "urls", F.when(has(md["urls"]), md["urls"]).otherwise(X.urls_from_text(content))))
