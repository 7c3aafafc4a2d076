import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chorus.llm import toxicity


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "river", "stone", "under", "market", "paper", "winter", "lantern", "bridge", "idea"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        body = [rng.choice(words) + (rng.choice(words) if rng.random() < 0.2 else "") for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["zorgle", "blaxa", "krunt" + rng.choice(words)]))
        docs.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    return docs, labels


def fold(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_rows_are_told_apart_and_never_learnt_from(spark, docs):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = spark.createDataFrame([(i, 1 - t if fold(i) else t) for i, t in labels], "doc_id long, toxic int")
    a, b = toxicity.fit(docs(rows), lab), toxicity.fit(docs(rows), flipped)
    assert a == b
    got = {r["doc_id"]: r for r in toxicity.score(docs(rows), a, score_col="s").withColumn(
        "h", toxicity.held_out(__import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id"))).collect()}
    assert all(got[i]["h"] == fold(i) for i, _ in rows)
    held = [(i, t) for i, t in labels if fold(i)]
    hit = sum((got[i]["s"] >= 0.3) == bool(t) for i, t in held)
    assert hit >= 0.97 * len(held)


def test_filter_keeps_columns_and_clean_rows(spark, docs):
    rows, labels = corpus()
    df = docs(rows)
    left = toxicity.reject_toxic(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert left.columns == df.columns
    ids = {r["doc_id"] for r in left.collect()}
    clean = [i for i, t in labels if not t]
    assert sum(i in ids for i in clean) >= 0.98 * len(clean)
    assert sum(i in ids for i, t in labels if t) <= 0.05 * sum(t for _, t in labels)


def test_label_model_discounts_voters_that_repeat_each_other():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    strong, weak = np.where(y, rng.random(2000) < 0.8, rng.random(2000) < 0.01), rng.random(2000) < 0.1
    fired = [np.array([0] * int(s) + [1, 2, 3] * int(w), int) for s, w in zip(strong, weak)]  # voters 1-3 always fire together
    post = toxicity.label_model(fired, y.astype(float), 4)
    assert ((post > 0.5) == y).mean() > 0.98
    noise_only = (~strong) & weak & ~y
    assert post[noise_only].mean() < 0.1


def test_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs([(1, "a")]), none)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs([(1, "you idiot"), (2, None), (3, ""), (None, "fine words")]), model).collect()}
    assert got[1] >= 0.3 > got[2] == got[3] and got[None] == got[3]
    assert toxicity.score(docs([]), model).count() == 0
    dup = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs([(1, "zap"), (1, "zap"), (2, "x")]), dup)["rows"] == (0 if fold(1) else 1)  # one text an id
    assert toxicity.score(docs([(1, "x")] * 3), model).count() == 3


@pytest.mark.parametrize("n,t", [(10, 10), (100, 20)])
def test_chance_bound_grows_with_support(spark, n, t):
    f = lambda t, n: toxicity.chance(F.lit(t), F.lit(n), 0.1)
    one, two = spark.range(1).select(f(t, n).alias("one"), f(2 * t, 2 * n).alias("two")).first()
    assert two == pytest.approx(2 * one) and one > 0


def test_counting_holds_one_small_slice(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(300)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0] * len(texts), pa.int32())], names=["text", "toxic"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in toxicity._count(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 0 and peak < 150e6, peak


def test_scoring_sends_texts_once(spark, docs, capsys):
    toxicity.score(docs([(1, "fine")]), {"features": ["=idiot"], "weights": [4.0], "bias": -3.0}).explain()
    assert "_text_of_score" not in capsys.readouterr().out
    binary = docs([(1, "you idiot")]).withColumn("text", F.col("text").cast("binary"))
    got = toxicity.score(binary, {"features": ["=idiot"], "weights": [4.0], "bias": -3.0}).first()
    assert got["toxicity"] > 0.3 and bytes(got["text"]) == b"you idiot"


def plain_features(text):
    """Feature set of a text, letter by letter."""
    out = set()
    for token in (text or "").lower().split(" "):
        word = ""
        for c in token + " ":
            if c.isalpha():
                word += c
                continue
            if len(word) > 2:
                out.add("=" + word)
                out |= {word[:k] + "*" for k in (4, 5, 6, 7) if len(word) > k}
            word = ""
    return out


def test_scores_equal_a_plain_scorer(spark, docs):
    rows, labels = corpus()
    rows += [(9001, None), (9002, ""), (9003, "Zorgle, ZORGLE! blaxa-krunt\nthe IDIOT's river"), (9004, "river " * 20_000 + "zorgle"), (None, "blaxa")]
    model = toxicity.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight = dict(zip(model["features"], model["weights"]))
    texts = dict(rows)
    for r in toxicity.score(docs(rows), model).collect():
        z = model["bias"] + sum(weight.get(f, 0.0) for f in plain_features((texts[r["doc_id"]] or "").replace("\n", " ")))
        assert r["toxicity"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30)))), r["doc_id"]


def test_counts_of_features_equal_a_plain_count(spark, docs):
    rows, labels = corpus(120)
    y = dict(labels)
    df = spark.createDataFrame([(t, y[i]) for i, t in rows], "text string, toxic int").repartition(3)
    got = {r["feature"]: (r["n"], r["t"]) for r in df.mapInArrow(toxicity._count, "feature string, n long, toxic long")
           .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t")).collect()}
    want = {}
    for i, t in rows:
        for f in plain_features(t):
            n, k = want.get(f, (0, 0))
            want[f] = (n + 1, k + y[i])
    assert got == want


def test_one_labelled_id_over_a_third_of_the_rows(spark, docs):
    rows, labels = corpus()
    hot = next(i for i, t in labels if t and not fold(i))
    text = dict(rows)[hot]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, many = toxicity.fit(docs(rows), lab), toxicity.fit(docs(rows + [(hot, text)] * 300), lab)
    assert plain == many and plain["rows"] == sum(not fold(i) for i, _ in labels)
    assert toxicity.fit(docs(rows), lab, max_train_rows=50)["rows"] == 50


def test_empty_documents_and_clashing_columns(spark, docs):
    rows, labels = corpus(50)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.reject_toxic(docs([]), lab).count() == 0
    df = docs(rows).withColumn("toxic", F.lit("x")).withColumn("feature", F.lit(1)).withColumn("score", F.lit(2)).withColumn("_id", F.lit(3))
    left = toxicity.reject_toxic(df, lab)
    assert left.columns == df.columns and left.where("toxic <> 'x' or feature <> 1 or score <> 2 or _id <> 3").count() == 0
    with pytest.raises(ValueError):
        toxicity.reject_toxic(df.withColumn("_toxicity", F.lit(0)), lab)
