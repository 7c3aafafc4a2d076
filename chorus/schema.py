"""The post data model.

A dataset of posts is one DataFrame with :data:`POST_SCHEMA`.  Platform
specific details live in the ``metadata`` struct (union of the twitter and
reddit fields, all nullable) and the ``engagement`` map.  ``sentiment`` is
null for posts that were never scored.  ``seq`` is the input order: every
first-wins rule (dedup, ``first`` platform, top-k ties) reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.session import ensure_checkpoint_dir, stage

STR = T.StringType()

METADATA_SCHEMA = T.StructType([
    # twitter
    T.StructField("lang", STR),
    T.StructField("hashtags", T.ArrayType(STR)),
    T.StructField("mentions", T.ArrayType(STR)),
    T.StructField("urls", T.ArrayType(STR)),
    T.StructField("is_retweet", T.BooleanType()),
    T.StructField("is_quote", T.BooleanType()),
    T.StructField("is_reply", T.BooleanType()),
    T.StructField("media_types", T.ArrayType(STR)),
    T.StructField("coordinates", T.StructType([
        T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])),
    # reddit
    T.StructField("subreddit", STR),
    T.StructField("subreddit_id", STR),
    T.StructField("is_self", T.BooleanType()),
    T.StructField("is_video", T.BooleanType()),
    T.StructField("is_original_content", T.BooleanType()),
    T.StructField("over_18", T.BooleanType()),
    T.StructField("spoiler", T.BooleanType()),
    T.StructField("stickied", T.BooleanType()),
    T.StructField("locked", T.BooleanType()),
    T.StructField("num_crossposts", T.LongType()),
    T.StructField("awards", T.LongType()),
    T.StructField("domain", STR),
    T.StructField("link_flair_text", STR),
    T.StructField("author_flair_text", STR),
])

SENTIMENT_SCHEMA = T.StructType([
    T.StructField("label", STR),
    T.StructField("score", T.DoubleType()),
    T.StructField("method", STR),
    T.StructField("compound", T.DoubleType()),
    T.StructField("original_text", STR),
    T.StructField("details", T.MapType(STR, T.DoubleType())),
])

POST_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("id", STR, False),
    T.StructField("platform", STR, False),
    T.StructField("author", STR),
    T.StructField("author_id", STR),
    T.StructField("content", STR),
    T.StructField("title", STR),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("engagement", T.MapType(STR, T.DoubleType())),
    T.StructField("url", STR),
    T.StructField("query", STR),
    T.StructField("metadata", METADATA_SCHEMA),
    T.StructField("sentiment", SENTIMENT_SCHEMA),
])

POST_COLUMNS = [f.name for f in POST_SCHEMA.fields]


def metadata_struct(**given: Column) -> Column:
    """Build a full metadata struct; fields not given are typed nulls."""
    parts = []
    for field in METADATA_SCHEMA.fields:
        value = given.get(field.name)
        if value is None:
            value = F.lit(None).cast(field.dataType)
        parts.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*parts)


def sentiment_struct(label: Column, score: Column, method: Column, *,
                     compound: Column | None = None,
                     original_text: Column | None = None,
                     details: Column | None = None) -> Column:
    def typed(c, name):
        dtype = SENTIMENT_SCHEMA[name].dataType
        return (c if c is not None else F.lit(None)).cast(dtype).alias(name)
    return F.struct(typed(label, "label"), typed(score, "score"), typed(method, "method"),
                    typed(compound, "compound"), typed(original_text, "original_text"),
                    typed(details, "details"))


def engagement_map(**counters: Column) -> Column:
    """Map of the non-null counters, in the order given."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value"))
                        for k, v in counters.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


ISO_LOCAL = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd"]
ISO_ZONED = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX"]


FILE_BITS = 40  # a file's positions lie below 2**40


def landed(df: DataFrame) -> DataFrame:
    """``df`` with ``seq``, the rows' position in the input, made once and
    written to the checkpoint folder: later plans read the same numbers, so
    first-wins rules and scalar subqueries over posts are deterministic.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.withColumn("seq", F.monotonically_increasing_id()).checkpoint(eager=True)


def landed_files(df: DataFrame) -> DataFrame:
    """Like :func:`landed` for rows read from files, with ``seq`` in (file path, position) order.

    ``df`` carries ``_metadata.file_path`` and ``_metadata.file_block_start`` as ``_path`` and ``_block``.
    A row's position is its block's first byte plus its number in the block, which cannot reach the
    next block's first byte; files are ranked by path.
    """
    rows = stage(df.withColumn("_mid", F.monotonically_increasing_id()), "landed")
    blocks = rows.groupBy("_path", "_block").agg(F.min("_mid").alias("_first"))  # one row per input split
    files = blocks.select("_path").distinct().select("_path", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy("_path")).alias("_rank"))
    blocks = blocks.join(files, "_path")
    seq = (F.col("_rank") - 1) * F.lit(1 << FILE_BITS) + F.col("_block") + F.col("_mid") - F.col("_first")
    # the few rows of the blocks go to the rows of the files, or else their texts would be shuffled
    return rows.join(F.broadcast(blocks), ["_path", "_block"]).withColumn("seq", seq).drop("_path", "_block", "_mid", "_first", "_rank")


def coerce_posts(df: DataFrame, batch_ts: Column | None = None) -> DataFrame:
    """Bring loosely typed rows to :data:`POST_SCHEMA`.

    ISO strings become timestamps (with ``Z`` or an offset: in UTC);
    unparseable ones take ``batch_ts`` (the ingestion instant, by default the
    query's current timestamp).  A missing engagement map becomes an empty
    map; missing columns become nulls.  Without ``seq`` the rows are landed
    (:func:`landed`) so their order is fixed.
    """
    if "seq" not in df.columns:
        df = landed(df)
    batch_ts = batch_ts if batch_ts is not None else F.localtimestamp()
    cols = []
    for field in POST_SCHEMA.fields:
        name = field.name
        if name not in df.columns:
            if name == "engagement":
                value = F.create_map().cast(field.dataType)
            else:
                value = F.lit(None).cast(field.dataType)
        elif name == "timestamp":
            raw = F.col(name)
            if isinstance(df.schema[name].dataType, T.StringType):
                local = F.coalesce(*[F.try_to_timestamp(raw, F.lit(p)) for p in ISO_LOCAL]).cast(T.TimestampNTZType())
                zoned = F.coalesce(*[F.try_to_timestamp(raw, F.lit(p)) for p in ISO_ZONED]).cast(T.TimestampNTZType())
                utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned)
                value = F.coalesce(local, utc, batch_ts)
            else:
                value = F.coalesce(raw.cast(T.TimestampNTZType()), batch_ts)
        elif name == "engagement":
            value = F.coalesce(F.col(name).cast(field.dataType), F.create_map().cast(field.dataType))
        elif name == "metadata":
            present = df.schema[name].dataType
            sub = {f.name: F.col(f"metadata.{f.name}") for f in present.fields
                   if f.name in METADATA_SCHEMA.names}
            value = F.when(F.col(name).isNull(), metadata_struct()).otherwise(metadata_struct(**sub))
        else:
            value = F.col(name).cast(field.dataType)
        cols.append(value.alias(name))
    return df.select(*cols)
