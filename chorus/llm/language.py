"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become words of letters (lower case, everything else is one space); the n-grams of one to three
characters inside a word and its two spaces are hashed to ``buckets``.  N-grams never span words, so texts can
lie end to end and long ones can be cut between words without changing a count.

* Training: every task counts (language, bucket) with NumPy over all training texts and gives its non-zero counts
  once; Spark adds them.  Nothing is sampled.
* Scoring: the matrix of log probabilities (buckets x languages, its size checked) is sent to every task; a
  batch is scored by gathers from the matrix, summed by text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import chunks, ready, stage

UNKNOWN = "und"
_PIECE = 1 << 20  # characters worked on at once
_HELD = 64  # languages whose counts a task holds at once


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> code point of its lower case (its first character), 0 for all that is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ord(ch.lower()[0])
    return out


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _letters()[points]


def _pieces(texts: list[str]):
    """(text numbers, pieces) with about _PIECE characters in all; a long text is cut before a non-letter."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + _PIECE - size)
            while end < len(t) and t[end].isalpha():
                end += 1
            rows.append(i)
            parts.append(t[at:end])
            size += end - at
            at = end
            if size >= _PIECE:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _grams(parts: list[str], bits: int):
    """(hash, piece) arrays, one pair for each n-gram order, over pieces laid end to end."""
    lengths = np.array([len(p) + 1 for p in parts])
    codes = np.concatenate([np.zeros(1, np.uint32), _codes(" ".join(parts)), np.zeros(1, np.uint32)])
    piece = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
    piece = np.concatenate([np.zeros(1, np.int32), piece])
    use = codes != 0
    use[1:] |= codes[:-1] != 0  # one space after each word
    use[0] = True
    c, piece = codes[use], piece[use]
    # a word's last space belongs to the word's piece, its first to the piece before it: n-grams take the piece
    # of their last letter
    letter = c != 0
    shift = np.uint32(32 - bits)
    with np.errstate(over="ignore"):
        x = c * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        one = x ^ (x >> np.uint32(15))
        two = one[:-1] * np.uint32(0x85EBCA77) + one[1:]
        two ^= two >> np.uint32(13)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + one[2:]
        three ^= three >> np.uint32(16)
        yield (one[letter] * np.uint32(0x27D4EB2F)) >> shift, piece[letter]
        at = letter[:-1] | letter[1:]
        yield (two[at] * np.uint32(0x165667B1)) >> shift, np.where(letter[1:], piece[1:], piece[:-1])[at]
        at = letter[1:-1]
        yield (three[at] * np.uint32(0xD3A2646D)) >> shift, piece[1:-1][at]


def _count(bits: int):
    def run(batches):
        held: dict[str, np.ndarray] = {}

        def rows(lang):
            got = held.pop(lang)
            at = np.flatnonzero(got)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32) - 1), pa.array(got[at], pa.int64())],
                names=["lang", "bucket", "n"])

        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                langs = part.column("lang").to_pylist()
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                for lang in dict.fromkeys(langs):
                    if lang not in held:
                        while len(held) >= _HELD:
                            yield rows(next(iter(held)))
                        held[lang] = np.zeros((1 << bits) + 1, np.int64)  # place 0 counts documents
                    own = [t for t, g in zip(texts, langs) if g == lang]
                    held[lang][0] += len(own)
                    for _, parts in _pieces(own):
                        for h, _ in _grams(parts, bits):
                            held[lang][1:] += np.bincount(h, minlength=1 << bits)
        while held:
            yield rows(next(iter(held)))
    return run


def fit(docs: DataFrame, bits: int = 15, alpha: float = 0.5, max_cells: int = 1 << 24, text_col: str = "text", lang_col: str = "lang",
        id_col: str = "doc_id") -> dict:
    """Model (languages, log priors, matrix of log probabilities) from all rows that are not ``held_out`` and have a language.

    Null texts count as documents without n-grams.  ``2 ** bits`` buckets times the languages may not exceed
    ``max_cells`` (the matrix is sent to every task); beyond it a ValueError is raised, nothing is dropped.
    Without training rows the model knows no language.
    """
    ready(docs)
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.mapInArrow(_count(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = stage(counts, "language-counts")
    n_langs = counts.where("bucket = -1").count()
    if n_langs << bits > max_cells:
        raise ValueError(f"{n_langs} languages x {1 << bits} buckets exceed max_cells={max_cells}")
    got = counts.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    place = {g: i for i, g in enumerate(langs)}
    table = np.zeros(((1 << bits) + 1, len(langs)))
    if langs:
        table[got.column("bucket").to_numpy() + 1, [place[g] for g in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    docs_of, grams = table[0], table[1:]
    with np.errstate(divide="ignore"):
        prior = np.log(docs_of / docs_of.sum()) if langs else np.zeros(0)
    return {"langs": langs, "bits": bits, "prior": prior, "logp": np.log((grams + alpha) / (grams.sum(0) + alpha * (1 << bits)))}


def _posteriors(texts: list[str], model: dict) -> np.ndarray:
    """texts x languages: log prior plus the summed log probabilities of the n-grams; -inf rows: no letter."""
    langs = len(model["langs"])
    out, seen = np.tile(model["prior"], (len(texts), 1)), np.zeros(len(texts), bool)
    for rows, parts in _pieces(texts):
        rows = np.array(rows)
        for h, piece in _grams(parts, model["bits"]):
            if len(h) == 0:
                continue
            seen[rows[piece]] = True
            starts = np.flatnonzero(np.diff(piece, prepend=-1))  # pieces lie end to end, so each is one run
            for g in range(langs):
                np.add.at(out[:, g], rows[piece[starts]], np.add.reduceat(model["logp"][:, g][h], starts))
    out[~seen] = -np.inf
    return out


def predict(docs: DataFrame, model: dict, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score",
            passthrough: list[str] | None = None) -> DataFrame:
    """``passthrough`` columns (default: all but the text and clashing ones) with the predicted language and its posterior probability.

    The score is the posterior of the predicted language, from 0 to 1; equal posteriors give the language first in
    order.  Texts that are null or without a letter, and all texts of a model without languages, get ``und``
    and 0.  Texts are read whole, long ones piece by piece.
    """
    spark = ready(docs)
    names = [c for c in (docs.columns if passthrough is None else passthrough) if c not in (text_col, lang_col, score_col)]
    lean = model | {"logp": np.asfortranarray(model["logp"])}
    sent = spark.sparkContext.broadcast(lean)
    keep = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.drop("__text").schema)
    fields = (fields + ", " if fields else "") + f"`{lang_col}` string, `{score_col}` double"

    def run(batches):
        m = sent.value
        for batch in batches:
            for part in chunks(batch, "__text", 4 << 20):
                texts = pc.fill_null(part.column("__text"), "").to_pylist()
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if m["langs"]:
                    post = _posteriors(texts, m)
                    best = post.argmax(1)
                    known = np.isfinite(post.max(1))
                    top = post[known, best[known]]
                    scores[known] = 1.0 / np.exp(post[known] - top[:, None]).sum(1)
                    for i in np.flatnonzero(known):
                        langs[i] = m["langs"][best[i]]
                cols = [part.column(c) for c in part.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores)], names=[*names, lang_col, score_col])

    return keep.mapInArrow(run, fields)
