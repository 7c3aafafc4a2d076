"""Helpers shared by the operators: staged tables, text batches, connected components."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.session import stage, unstage

#: Fixed value: the byte class the contracts call white space.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package's code sent to the executors (once per context).

    Python workers import the functions they run; ``addPyFile`` is what ``--py-files`` does, so a job
    needs no installation on the workers.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not getattr(sc, "_chorus_sent", False):
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="chorus-code-")  # on the driver only; Spark serves it to executors
        with zipfile.ZipFile(f"{folder}/chorus_code.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        sc.addPyFile(f"{folder}/chorus_code.zip")
        sc._chorus_sent = True
    return spark


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20):
    """Slices of ``batch`` whose ``column`` holds about ``max_bytes`` (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the row offsets (nulls are empty)."""
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1, offset=col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, component = smallest node reachable).

    Alternating large-star / small-star rounds (Kiveris et al. 2014): every round is two map-side
    combined minima and two equi-joins over the edge list, which never grows; the rounds number
    O(log^2) of the longest chain.  Each round's edges are staged, nothing is collected.
    """
    e = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = stage(small, "cc")
        same = nxt.exceptAll(e).isEmpty() and e.exceptAll(nxt).isEmpty()
        e = nxt
        if same:
            break
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
