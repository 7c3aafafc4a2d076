import random

import corpus_pipeline
from chorus.llm import queries


def test_stages_compose_on_small_tables(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioutnshrdl") for _ in range(rng.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    docs = [(i, text(rng.randint(80, 200)), "en", f"src{i % 3}") for i in range(120)]
    docs += [(200 + i, text(100) + " " + passage + " " + text(100), "en", "src1") for i in range(5)]
    docs += [(300, docs[4][1], "en", "src0"), (301, docs[5][1] + " " + word(), "en", "src2"), (302, None, None, None), (303, "", "en", None)]
    docs += [(400 + i, text(30) + " zorgle idiot " + text(30), "en", "src0") for i in range(40)]
    rows = [(d, t, lang, s, len(t) if t is not None else None) for d, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(400 <= d)) for d, *_ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "mix", "pack"]
    cur = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, cur, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert out.columns == cur.columns, name
            cur = spark.read.parquet(f"{tmp_path}/{name}")
            seen[name] = {r["doc_id"]: r["text"] for r in cur.collect()}
    assert not any(400 <= d for d in seen["toxicity"]) and set(range(120)) <= set(seen["toxicity"])
    assert set(seen["toxicity"]) - set(seen["near_copies"]) == {300, 301}
    assert all(passage[20:-20] not in (t or "") for t in seen["repeats"].values())
    assert all(seen["repeats"][i] == docs[i][1] for i in range(120))
    assert len(seen["mix"]) > 60
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_repeats_are_passages_of_over_fifty_words(spark):
    rng = random.Random(9)
    text = lambda n, size: " ".join("".join(rng.choice("aeioutnshrdl") for _ in range(rng.randint(*size))) for _ in range(n))
    short, fifty, long = text(51, (1, 3)), text(50, (2, 3)), text(25, (11, 14))
    assert 101 <= len(short) < 250 and len(fifty) < 250 <= len(long)
    rows = [(i, f"{text(60, (3, 9))}! {p} ?{text(60, (3, 9))}") for i, p in enumerate([short, short, fifty, fifty, long, long])]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert all(short[5:-5] not in got[i] and long[5:-5] not in got[i] for i in range(6))
    assert got[2] == rows[2][1] and got[3] == rows[3][1]


def test_every_operator_is_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert names == list(range(1, 14))
