"""One JSON document as a source and a sink: ``{"posts": [{...}, ...], ...}`` or a bare list.

*Reading* splits the file at object borders.  Spark's text reader cuts it at every ``{`` and deals byte ranges
(blocks) to tasks, on any file system that Spark reads; whether a task's first byte lies inside a string, and
how deep, is not known there.  So a first pass summarises every block for both cases (ends inside a string,
change of depth), the driver runs through the summaries (one row a block), and the second pass cuts out the
elements of the named arrays.  An element over a block border comes in fragments, which are joined by their place.

*Writing* orders a section's lines in many tasks, a slice of them at a time, and adds each slice's part files to the
one file, which is then moved to its name: besides the document a slice is on disk.  One file has one writer, so the
driver's file system copies the parts' bytes, a buffer at a time.  For results of any size use
``chorus.plans.export.write_analysis`` (folders).
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.session import ensure_checkpoint_dir, send_code, shuffles_released

_WRITE_SLICES = 8
_QUOTE, _SLASH, _OPEN, _CLOSE, _LIST, _END = (ord(c) for c in '"\\{}[]')


def _scan(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of quotes that are not escaped, places of brackets and braces, their steps +1 or -1)"""
    quotes = np.flatnonzero(data == _QUOTE)
    after = quotes[(quotes > 0) & (data[np.maximum(quotes - 1, 0)] == _SLASH)]
    if len(after):
        other = np.flatnonzero(data != _SLASH)
        before = np.searchsorted(other, after) - 1
        run = after - 1 - np.where(before >= 0, other[np.maximum(before, 0)], -1)
        quotes = np.setdiff1d(quotes, after[run % 2 == 1], assume_unique=True)
    places = np.flatnonzero((data == _OPEN) | (data == _LIST) | (data == _CLOSE) | (data == _END))
    return quotes, places, np.where((data[places] == _OPEN) | (data[places] == _LIST), 1, -1)


def _pieces(batch) -> list[tuple[int, bytes]]:
    """(block, bytes) of a batch: the records of a block with the ``{`` that each was cut at."""
    starts, texts = batch.column("block").to_pylist(), batch.column("value").to_pylist()
    out, a = [], 0
    for b in range(1, len(starts) + 1):
        if b == len(starts) or starts[b] != starts[a]:
            out.append((starts[a], "{" + "{".join(texts[a:b])))
            a = b
    return [(block, text.encode()) for block, text in out]


def _summaries(batches):
    held: dict[int, list] = {}  # block -> [quotes, depth change if it starts outside, inside a string, first bytes]
    for batch in batches:
        for block, raw in _pieces(batch):
            data = np.frombuffer(raw, np.uint8)
            quotes, places, steps = _scan(data)
            inside = np.searchsorted(quotes, places) % 2
            s = held.setdefault(block, [0, 0, 0, raw[:1024].decode("utf-8", "replace")])
            flip = s[0] % 2
            for case in (0, 1):
                s[1 + case] += int(steps[inside == (case + flip) % 2].sum())
            s[0] += len(quotes)
    rows = [(b, s[0] % 2, s[1], s[2], s[3]) for b, s in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))],
                                     names=["block", "odd", "outside", "inside", "head"])


def _elements(starts: dict[int, tuple[int, int, int]], depth_of: int):
    """Rows (block number, at, kind, text): whole elements, fragments (head, middle, tail) and the keys of top-level values."""
    def run(batches):
        state: dict[int, dict] = {}
        for batch in batches:
            rows = []
            for block, raw in _pieces(batch):
                if block not in state:
                    number, inside, depth = starts[block]
                    state[block] = {"number": number, "inside": inside, "depth": depth, "at": 0, "open": None, "text": [], "carried": depth > depth_of, "key": b""}
                rows += _walk(raw, state[block], depth_of)
            yield _rows(rows)
        rows = []
        for s in state.values():
            if s["open"] is not None or s["carried"]:
                rows.append((s["number"], s["open"] or 0, "middle" if s["carried"] else "head", b"".join(s["text"]).decode()))
        yield _rows(rows)
    return run


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                      names=["block", "at", "kind", "text"])


def _walk(raw: bytes, s: dict, depth_of: int) -> list[tuple]:
    data = np.frombuffer(raw, np.uint8)
    quotes, places, steps = _scan(data)
    real = (np.searchsorted(quotes, places) + s["inside"]) % 2 == 0
    places, steps = places[real], steps[real]
    depth = s["depth"] + np.cumsum(steps)
    rows, done = [], 0
    # braces that open or close an element, and what opens a top-level value (its key stands right before)
    hits = np.flatnonzero(((steps > 0) & (depth == depth_of + 1) & (data[places] == _OPEN)) | ((steps < 0) & (depth == depth_of) & (data[places] == _CLOSE))
                          | ((steps > 0) & (depth == depth_of) & (depth_of == 2)))
    for i in hits:
        p = int(places[i])
        if steps[i] > 0 and depth[i] == depth_of:
            name = ""  # no elements of an object are asked for
            if data[p] == _LIST:
                before = (s["key"] + raw[max(0, p - 4096):p])[-4096:].rstrip().rstrip(b":").rstrip()
                name = json.loads(before[before.rfind(b'"', 0, len(before) - 1):]) if before.endswith(b'"') else ""
            rows.append((s["number"], s["at"] + p, "value", name))
        elif steps[i] > 0:
            s["open"], s["text"], s["carried"], done = s["at"] + p, [], False, p
        elif s["open"] is not None or s["carried"]:
            text = b"".join(s["text"]) + raw[done:p + 1]
            rows.append((s["number"], s["open"] if s["open"] is not None else 0, "tail" if s["carried"] else "whole", text.decode()))
            s["open"], s["text"], s["carried"] = None, [], False
    if s["open"] is not None or s["carried"]:
        s["text"].append(raw[done:])
    s["key"] = (s["key"] + raw[-4096:])[-4096:]  # a top-level key of more than 4 KB is not found
    s["inside"] = (s["inside"] + len(quotes)) % 2
    s["depth"] = int(depth[-1]) if len(depth) else s["depth"]
    s["at"] += len(raw)
    return rows


def read_document(spark: SparkSession, path: str, schemas: dict[str, T.DataType]) -> dict[str, DataFrame]:
    """The named arrays of a JSON document as frames, in the schemas' columns (a map schema: one column ``e``) plus
    ``_place``, which orders them as the document does.

    A bare list is the array of the only schema asked for.  An array the document does not hold gives an empty
    frame; elements that are no objects are left out, as is everything deeper than the arrays.  Spark decides
    the splits (``spark.sql.files.maxPartitionBytes``); a compressed file is one split.
    """
    send_code(spark)
    # cut at every brace; the file's own first record has none before it, which one more level of depth makes up for
    records = spark.read.option("lineSep", "{").text(path).select("value", F.col("_metadata.file_block_start").alias("block"))
    blocks = sorted(records.mapInArrow(_summaries, "block long, odd int, outside long, inside long, head string").collect())  # one row a block
    if not blocks:
        blocks = [{"block": 0, "odd": 0, "outside": 0, "inside": 0, "head": "{{"}]
    bare = blocks[0]["head"][1:].lstrip("﻿ \t\r\n").startswith("[")
    starts, inside, depth = {}, 0, -1
    for number, b in enumerate(blocks):
        starts[b["block"]] = (number, inside, depth)
        depth += b["inside"] if inside else b["outside"]
        inside = (inside + b["odd"]) % 2
    depth_of = 1 if bare else 2
    found = records.mapInArrow(_elements(starts, depth_of), "block long, at long, kind string, text string")
    # the file holds still, so its elements are cut out again by whoever reads them instead of being written a second time
    marks = found.where("kind <> 'whole'").select("block", "at", "kind", F.when(F.col("kind") == "value", F.col("text")).alias("name")).collect()
    # at most two fragments a block, and the document's top-level values
    marks.sort(key=lambda r: (r["block"], {"tail": 0, "middle": 0, "value": 1, "head": 1}[r["kind"]], r["at"]))
    head, of_fragment = None, []
    for r in marks:
        if r["kind"] == "head":
            head = (r["block"], r["at"])
        if r["kind"] != "value" and head:
            of_fragment.append((r["block"], r["at"], r["kind"], *head))
        if r["kind"] == "tail":
            head = None
    values = sorted((r["block"], r["at"], r["name"]) for r in marks if r["kind"] == "value")
    place = lambda block, at: F.shiftleft(F.col(block), 36) + F.col(at)
    whole = found.where("kind = 'whole'").select("text", place("block", "at").alias("_place"))
    if of_fragment:
        parts = spark.createDataFrame(of_fragment, "block long, at long, kind string, b long, a long")
        whole = whole.unionByName(
            found.join(F.broadcast(parts), ["block", "at", "kind"]).groupBy("b", "a")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
            .select("text", place("b", "a").alias("_place")))
    out = {}
    for name, schema in schemas.items():
        mine = whole
        if not bare:
            at = [(x[0] << 36) + x[1] for x in values] + [1 << 62]
            own = F.lit(False)
            for i, x in enumerate(values):
                if x[2] == name:
                    own = own | F.col("_place").between(at[i], at[i + 1])
            mine = whole.where(own)
        out[name] = mine.select(F.from_json("text", schema).alias("e"), "_place").select("e.*" if isinstance(schema, T.StructType) else "e", "_place")
    return out


def write_document(path: str, sections: dict[str, DataFrame | dict | list], order: str = "seq") -> None:
    """One JSON document: a frame becomes an array of objects (by its ``order`` column, if it has one; keys sorted,
    null fields left out), anything else is written as it is.  An existing file is replaced."""
    spark = next(v.sparkSession for v in sections.values() if isinstance(v, DataFrame))
    ensure_checkpoint_dir(spark)
    jvm, last = spark.sparkContext._jvm, len(sections) - 1
    here = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = here(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    out = fs.create(here(f"{folder}/document"))
    try:
        for i, (name, value) in enumerate(sections.items()):
            opening, comma = ("{" if i == 0 else "") + json.dumps(name, ensure_ascii=False) + ": ", ("}" if i == last else ",") + "\n"
            if not isinstance(value, DataFrame):
                out.write((opening + json.dumps(value, ensure_ascii=False, sort_keys=True) + comma).encode())
                continue
            out.write((opening + "[\n").encode())
            for n, lines in enumerate(_line_slices(value, order)):
                with shuffles_released(spark):
                    lines.write.text(f"{folder}/{i}-{n}")
                for part in sorted(str(x.getPath()) for x in fs.globStatus(here(f"{folder}/{i}-{n}/part-*"))):
                    rows = fs.open(here(part))
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(rows, out, 1 << 20, False)
                    rows.close()
                    fs.delete(here(part), False)
            out.write(("]" + comma).encode())
        out.close()
        if fs.exists(here(path)) and not fs.delete(here(path), False):
            raise OSError(f"cannot replace {path}")
        if not fs.rename(here(f"{folder}/document"), here(path)):
            raise OSError(f"cannot move the document to {path}")
    finally:
        out.close()
        fs.delete(here(folder), True)


def _line_slices(value: DataFrame, order: str) -> list[DataFrame]:
    """The lines of a section, in order, as frames of about as many rows each."""
    ordered = order in value.columns
    rank = F.col(order) if ordered else F.monotonically_increasing_id()
    rows = value.select(rank.cast("long").alias("ord"), F.to_json(F.struct(*sorted(value.columns)), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("line"))
    # numbers given here must hold for all passes; a column of the rows does, and its places need no line
    rows = rows if ordered else rows.checkpoint(eager=True)
    shares = [F.lit(k / _WRITE_SLICES) for k in range(1, _WRITE_SLICES)]
    first, cuts = rows.agg(F.min("ord"), F.percentile_approx("ord", F.array(*shares), 10_000)).first()
    cuts = sorted(set(cuts or []))
    lines = rows.withColumn("line", F.when(F.col("ord") > first, F.concat(F.lit(","), "line")).otherwise(F.col("line")))
    slices = [lines.where(F.lit(True) if not cuts else F.coalesce(F.col("ord") <= cuts[0], F.lit(True)))]
    slices += [lines.where((F.col("ord") > low) & (F.col("ord") <= high)) for low, high in zip(cuts, cuts[1:])]
    slices += [lines.where(F.col("ord") > cuts[-1])] if cuts else []
    return [s.repartitionByRange("ord").sortWithinPartitions("ord").select("line") for s in slices]


def numbered(rows: DataFrame) -> DataFrame:
    """Rows in document order with ``seq`` from 0 where none of them has one.  Numbers are prefix sums of counts over
    ranges of places, so no task holds the document."""
    if rows.where("seq is null").isEmpty():
        return rows.drop("_place")
    wide = rows.withColumn("_range", (F.col("_place") / F.lit(1 << 22)).cast("long"))
    counts = wide.groupBy("_range").agg(F.count("*").alias("n"))
    before = counts.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("before"))  # one row a 2 MB range
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_place"))
    return wide.withColumn("_own", own).join(before, "_range").withColumn("seq", F.col("before") + F.col("_own") - 1).drop("_range", "_own", "before", "_place")
