"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model over their
votes, and a linear classifier trained on the model's posterior labels.

Fitting uses a bounded sample of labelled rows (``max_train_rows``, the smallest by a hash of the id), the
only thing ever gathered on the driver:

1. voters: words (lexicon) and word beginnings (patterns) whose share of toxic rows in the sample is too
   high for chance over all features seen (a binomial tail test), and a small hand-written lexicon;
2. label model: each voter fires at one rate on toxic and another on clean rows; the given label is one
   more voter that may err.  Rates and posteriors are found by EM; voters that fire together beyond what
   the class explains share their weight (pairwise correlation given the class);
3. classifier: logistic regression on the posteriors over the presence of the selected features.

Scoring is one narrow pass over whole texts with a few thousand weights sent to every task.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.llm.common import chunks, ready, stage

#: Hand-written lexicon, one voter a word (its words need no support in the sample).
LEXICON = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "bastard",
           "asshole", "bitch", "retard", "imbecile", "dumbass", "dummkopf", "arschloch", "schlampe", "connard",
           "salope", "ordure", "gilipollas", "cabrón", "imbécil")
_LETTERS = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6, 7)
_KNOWN = 150_000
#: Counting numbers every feature of a slice, some thirty times its bytes in memory.
_COUNT_BYTES = 1 << 20


def features_of(token: str) -> list[str]:
    """Feature names of one white-space token: its words, and beginnings of 4 to 7 letters of longer words."""
    out = []
    for w in _LETTERS.findall(token.lower()):
        if len(w) > 2:
            out.append("=" + w)
            out.extend(w[:n] + "*" for n in _PREFIXES if len(w) > n)
    return out


def _tokens(texts: pa.Array):
    """(distinct tokens, code of every token, row of every token)"""
    flat = pc.fill_null(texts, "")
    for c in "\n\t\r":
        flat = pc.replace_substring(flat, c, " ")
    split = pc.split_pattern(flat, " ")
    coded = split.values.dictionary_encode()
    rows = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), rows


def _row_features(texts: pa.Array, index: dict[str, int] | None, memo: dict):
    """Distinct (row, feature) pairs; ``index`` restricts to known features, else all are numbered."""
    words, codes, rows = _tokens(texts)
    names = {} if index is None else index
    per = []
    for w in words:
        got = memo.get(w)
        if got is None:
            fs = features_of(w)
            got = tuple({names.setdefault(f, len(names)) for f in fs} if index is None else {index[f] for f in fs if f in index})
            if index is not None and len(memo) < _KNOWN:
                memo[w] = got
        per.append(got)
    n = np.fromiter(map(len, per), np.int64, len(per))
    flat = np.fromiter((i for x in per for i in x), np.int64, int(n.sum()))
    first = np.cumsum(n) - n
    use = n[codes] > 0
    codes, rows = codes[use], rows[use]
    k = n[codes]
    at = np.repeat(first[codes] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
    pairs = np.unique(np.repeat(rows, k) * (len(names) + 1) + flat[at]) if len(k) else np.zeros(0, np.int64)
    return pairs // (len(names) + 1), pairs % (len(names) + 1), names


def _count_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
    y = batch.column("toxic").to_numpy()
    r, f, names = _row_features(batch.column("text"), None, {})
    n = np.bincount(f, minlength=len(names))
    t = np.bincount(f, weights=y[r], minlength=len(names)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(n, pa.int64()), pa.array(t, pa.int64())],
                                      names=["feature", "n", "toxic"])


def _count(batches):
    """Rows (feature, n, toxic): in how many rows of a slice of texts a feature occurs."""
    for whole in batches:
        for batch in chunks(whole, "text", _COUNT_BYTES):
            yield _count_slice(batch)


def _votes(index: dict[str, int]):
    def run(batches):
        memo: dict = {}
        for whole in batches:
            for batch in chunks(whole, "text"):
                r, f, _ = _row_features(batch.column("text"), index, memo)
                cuts = np.searchsorted(r, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(f, pa.int32()))],
                    names=["toxic", "fired"])
    return run


def chance(t: Column, n: Column, prior: float) -> Column:
    """Bound on -log of the chance of ``t`` or more toxic rows out of ``n`` at rate ``prior`` (0 where t/n <= prior)."""
    p = F.least(F.greatest(t / n, F.lit(1e-12)), F.lit(1 - 1e-12))
    kl = p * F.log(p / F.lit(prior)) + (1 - p) * F.log((1 - p) / F.lit(1 - prior))
    return F.when(t / n > prior, n * kl).otherwise(F.lit(0.0))


def label_model(fired: list[np.ndarray], given: np.ndarray, n_voters: int, rounds: int = 12) -> np.ndarray:
    """Posterior chance of toxic for every sample row, from its votes and its (fallible) given label.

    Bernoulli class-conditional voters fitted by EM.  Correlations given the class are estimated from the
    posteriors; a voter's evidence is divided by one plus its positive correlations with the others.
    """
    n = len(given)
    v = np.zeros((n, n_voters), np.float32)
    for i, f in enumerate(fired):
        v[i, f] = 1
    post = np.where(given > 0, 0.95, 0.02)
    for _ in range(rounds):
        w1, w0 = post.sum() + 1e-9, (1 - post).sum() + 1e-9
        p1 = (post @ v + 0.5) / (w1 + 1)
        p0 = ((1 - post) @ v + 0.1) / (w0 + 1)
        if n_voters:
            share = np.ones(n_voters)
            for weight, p in ((post, p1), (1 - post, p0)):
                d = (v - p) * np.sqrt(weight)[:, None]
                cov = d.T @ d
                s = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
                corr = np.clip(cov / np.outer(s, s), 0, 1)
                np.fill_diagonal(corr, 0)
                share = np.maximum(share, 1 + np.where(corr > 0.2, corr, 0).sum(1))
            on, off = np.log(p1 / p0) / share, np.log((1 - p1) / (1 - p0)) / share
            odds = v @ (on - off) + off.sum()
        else:
            odds = np.zeros(n)
        hit = np.clip((post * (given > 0)).sum() / w1, 0.5, 0.995)
        false = np.clip(((1 - post) * (given > 0)).sum() / w0, 0.001, 0.2)
        odds = odds + np.where(given > 0, np.log(hit / false), np.log((1 - hit) / (1 - false))) + np.log(w1 / w0)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def fit_linear(fired: list[np.ndarray], target: np.ndarray, n_features: int, l2: float = 0.02, steps: int = 400):
    """Logistic regression on soft labels, rows as lists of present features: (weights, bias)."""
    rows = np.repeat(np.arange(len(fired)), [len(f) for f in fired])
    cols = np.concatenate([*fired, np.zeros(0, np.int64)]).astype(np.int64)
    w, m, s = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    n = len(target)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.append(np.bincount(cols, weights=err[rows], minlength=n_features) + l2 * w[:-1] / n, err.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def held_out(id_col: Column) -> Column:
    """The contract's test fold: crc32 of the id as text leaves 2 modulo 4 (null ids are not in it)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, max_features: int = 2_000, max_voters: int = 300,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The model: feature names, weights, bias, sample rows.

    ``max_train_rows`` bounds the labelled ids and with them the sample, one text an id (the smallest where an
    id repeats, so a repeated id weighs no more than another); it is all that reaches the driver.
    ``max_features`` and ``max_voters`` are the size of the classifier and of the label model: the best of
    the features that pass the test.  Rows of the test fold, without a label or without a text row are not used; ids
    with several labels count as toxic if any says so; null ids and labels are left out; null texts are empty.
    Without any usable label the lexicon alone scores.
    """
    ready(docs)
    lab = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
           .groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic")))
    lab = lab.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(max_train_rows)
    lab = lab.sparkSession.createDataFrame(lab.collect(), lab.schema)  # at most max_train_rows pairs
    mine = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = stage(mine.join(F.broadcast(lab), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
                   .select("text", "toxic"), "toxic")
    size = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    rows, positive = size[0], size[1] or 0
    chosen: list[str] = ["=" + w for w in LEXICON]
    prior = (positive + 0.5) / (rows + 1) if rows else 0.05
    if positive:
        counts = (sample.mapInArrow(_count, "feature string, n long, toxic long").groupBy("feature")
                  .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where("toxic >= 3"))
        counts = stage(counts, "toxic-features")
        tested = counts.count()
        voters = (counts.withColumn("z", chance(F.col("toxic"), F.col("n"), prior))
                  .where((F.col("z") >= math.log(max(tested, 1))) & (F.col("toxic") >= 0.5 * F.col("n"))))
        best = [r["feature"] for r in voters.orderBy(F.round("z", 9).desc(), "feature").limit(max_features).collect()]
        chosen = best + [f for f in chosen if f not in set(best)]
    index = {f: i for i, f in enumerate(chosen)}
    got = sample.mapInArrow(_votes(index), "toxic int, fired array<int>").collect()  # a short list a sample row
    fired = [np.array(r["fired"], np.int64) for r in got]
    given = np.array([r["toxic"] for r in got], float)
    if not len(given):
        return {"features": chosen, "weights": [4.0] * len(chosen), "bias": -3.0, "rows": 0}
    voters = min(max_voters, len(chosen))
    post = label_model([f[f < voters] for f in fired], given, voters)
    w, b = fit_linear(fired, post, len(chosen))
    unseen = np.bincount(np.concatenate([*fired, np.zeros(0, np.int64)]), minlength=len(chosen)) == 0
    w = np.where(unseen, 4.0, w)  # lexicon words that the sample doesn't hold
    return {"features": chosen, "weights": w.tolist(), "bias": b, "rows": rows}


def _score(model, names, text, extra):
    def run(batches):
        index, weights = {f: i for i, f in enumerate(model.value["features"])}, np.array(model.value["weights"])
        memo: dict = {}
        for whole in batches:
            for batch in chunks(whole, text):
                r, f, _ = _row_features(batch.column(text), index, memo)
                z = np.bincount(r, weights=weights[f], minlength=batch.num_rows) + model.value["bias"]
                score = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), score], names=[*names, extra])
    return run


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score of each row (0 to 1).  Null and empty texts get the score of a
    text without any feature; a column already called ``score_col`` is replaced."""
    spark = ready(docs)
    sent = spark.sparkContext.broadcast(model)  # max_features names and weights
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    if text_col in docs.columns and docs.schema[text_col].dataType == T.StringType():  # texts go to the task once
        return docs.mapInArrow(_score(sent, docs.columns, text_col, score_col), schema)
    own = "_text_of_score"
    return docs.withColumn(own, F.col(text_col).cast("string")).mapInArrow(_score(sent, docs.columns, own, score_col), schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged (model fitted on these docs).

    Null and empty texts score as a text without features and stay; repeated rows are judged alike, each
    stays or goes; null ids are scored but not learnt from; no rows, no rows; without labels the lexicon alone
    judges.  A column of ``docs`` called ``_toxicity`` clashes with the working column and raises an error.
    """
    model = fit(docs, labels, **params)
    column = "_toxicity"
    if column in docs.columns:
        raise ValueError(f"{column} is the working column of reject_toxic")
    return score(docs, model, score_col=column).where(F.col(column) < threshold).select(*docs.columns)
