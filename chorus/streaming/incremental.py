"""D7 on Structured Streaming: de-duplicate each micro-batch against all
posts kept by earlier batches.

The reference keeps its seen ids / hashes in memory across ``deduplicate``
calls.  Here they are a table of ``(id_key, hash_key)`` written per epoch
under ``state_path/epoch=N``; batch ``N`` reads epochs ``< N``.  Outputs and
state of an epoch are written with overwrite to that epoch's folder, so a
replayed epoch (after a failure) produces the same files — the sink is
idempotent and survives executor or driver loss together with the stream
checkpoint.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chorus.operators.dedup import dedup_incremental, dedup_keys, settle_batch
from chorus.session import send_code

SEEN_SCHEMA = "id_key string, hash_key string, epoch bigint"


def _seen(spark, state_path: str, epoch_id: int) -> DataFrame:
    if not _exists(spark, state_path):
        return spark.createDataFrame([], SEEN_SCHEMA).drop("epoch")
    return spark.read.schema(SEEN_SCHEMA).parquet(state_path).filter(F.col("epoch") < epoch_id).drop("epoch")


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def dedup_batch_writer(state_path: str, output_path: str, empty_content: str = "collapse"):
    """``foreachBatch`` function: tag one micro-batch and record its kept keys."""
    def process(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        seen = _seen(spark, state_path, epoch_id)
        tagged, _ = dedup_incremental(batch, seen, empty_content)
        tagged = tagged.checkpoint(eager=True)  # one evaluation feeds both writes
        (tagged.drop("id_key", "hash_key").write.mode("overwrite")
               .parquet(os.path.join(output_path, f"epoch={epoch_id}")))
        kept = tagged.filter("kept").select("id_key", "hash_key")
        kept.write.mode("overwrite").parquet(os.path.join(state_path, f"epoch={epoch_id}"))
    return process


def start_dedup_stream(stream: DataFrame, state_path: str, output_path: str, checkpoint_location: str,
                       trigger: dict | None = None, empty_content: str = "collapse"):
    """Start the streaming dedup; ``stream`` is a streaming DataFrame of posts with ``seq``."""
    w = (stream.writeStream.foreachBatch(dedup_batch_writer(state_path, output_path, empty_content))
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


KEPT_SCHEMA = "key string"
_ASKED = "seq long, kind string, key string, post string, seen boolean"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NTZ = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _answer(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's rows of a batch, frame by frame: questions (with ``seq``) are answered from the state, a kept key
    of an earlier batch becomes state and goes on as one row without ``seq``, for questions that came before it."""
    for frame in frames:
        if not state.exists and frame["seq"].isna().any():
            state.update((True,))
            yield frame[frame["seq"].isna()].head(1)[["seq", "kind", "key", "post"]].assign(seen=True)
        asked = frame[frame["seq"].notna()]
        if len(asked):
            yield asked[["seq", "kind", "key", "post"]].assign(seen=state.exists)


def _questions(posts: DataFrame, empty_content: str) -> DataFrame:
    """Two rows a post, one for each key; the post travels with its id."""
    both = F.array(F.struct(F.lit("id").alias("kind"), F.concat(F.lit("i:"), F.concat_ws(":", "platform", "id")).alias("key"),
                            F.to_json(F.struct(*posts.columns), _NTZ).alias("post")),
                   F.struct(F.lit("hash").alias("kind"), F.concat(F.lit("h:"), F.col("hash_key")).alias("key"),
                            F.lit(None).cast("string").alias("post")))
    keyed = dedup_keys(posts, empty_content, keep=posts.columns)
    return keyed.select("seq", F.explode(both).alias("q")).select("seq", "q.kind", "q.key", "q.post")


def start_keyed_dedup_stream(stream: DataFrame, state_path: str, output_path: str, checkpoint_location: str,
                             trigger: dict | None = None, empty_content: str = "collapse"):
    """Start the dedup with keyed state; the rows written equal those of ``start_dedup_stream``.

    ``stream`` holds posts with a ``seq`` that is unique and grows from batch to batch.  ``state_path`` receives the
    kept keys of each batch, ``output_path`` the tagged posts, one folder a batch, both replaced when a batch is
    replayed.  The trigger may be the default or ``processingTime``: the query must see the kept keys it wrote
    itself, which ``availableNow`` and ``once`` fix at their start, so they raise a ValueError.  Empty batches
    write nothing.
    """
    trigger = trigger or {}
    if trigger.keys() - {"processingTime"}:
        raise ValueError("start_keyed_dedup_stream needs the default or a processingTime trigger; use start_dedup_stream")
    spark = stream.sparkSession
    send_code(spark)
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    kept_path = f"{state_path.rstrip('/')}/kept"
    if not _exists(spark, kept_path):
        spark.createDataFrame([], KEPT_SCHEMA).write.parquet(f"{kept_path}/epoch=-1")
    kept = spark.readStream.schema(KEPT_SCHEMA).option("recursiveFileLookup", "true").parquet(kept_path)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("seq", "long"), ("kind", "string"))]
    rows = _questions(stream, empty_content).unionByName(kept.select(*none, "key", F.lit(None).cast("string").alias("post")))
    asked = rows.groupBy("key").applyInPandasWithState(
        _answer, _ASKED, "seen boolean", "append", GroupStateTimeout.NoTimeout)
    schema = stream.schema

    def process(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.checkpoint(eager=True)  # the state answers once; everything below reads this
        if batch.where("seq is not null").isEmpty():
            return
        late = batch.where("seq is null").select("key", F.lit(True).alias("late")).distinct()
        answers = batch.where("seq is not null").join(late, "key", "left").withColumn("seen", F.col("seen") | F.coalesce("late", F.lit(False)))
        by_id = answers.where("kind = 'id'").select("seq", F.expr("substring(key, 3)").alias("id_key"), F.col("seen").alias("old_id"), "post")
        by_hash = answers.where("kind = 'hash'").select("seq", F.expr("substring(key, 3)").alias("hash_key"), F.col("seen").alias("old_hash"))
        flags = settle_batch(by_id.drop("post").join(by_hash, "seq")).checkpoint(eager=True)
        posts = by_id.select(F.from_json("post", schema, _NTZ).alias("p")).select("p.*")
        (posts.join(flags.select("seq", "kept", "dup_type"), "seq").write.mode("overwrite")
              .parquet(os.path.join(output_path, f"epoch={epoch_id}")))
        new = flags.where("kept").select(F.explode(F.array(F.concat(F.lit("i:"), "id_key"), F.concat(F.lit("h:"), "hash_key"))).alias("key"))
        new.write.mode("overwrite").parquet(f"{kept_path}/epoch={epoch_id}")

    w = asked.writeStream.foreachBatch(process).outputMode("append").option("checkpointLocation", checkpoint_location)
    return (w.trigger(**trigger) if trigger else w).start()
