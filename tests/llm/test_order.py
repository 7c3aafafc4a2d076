import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chorus.llm import order, tokens


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation_with_an_inverse(n):
    slots = order.feistel(np.arange(n), n, key=9)
    assert sorted(slots) == list(range(n))
    assert (order.feistel(slots, n, 9, inverse=True) == np.arange(n)).all()
    if n > 100:
        assert (order.feistel(np.arange(n), n, 10) != slots).mean() > 0.9
        assert np.corrcoef(np.arange(n), slots)[0, 1] < 0.2


def test_shards_hold_every_id_once_in_slot_order(spark, docs):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i * 3 % 50))) for i in range(80)] + [(200, None), (201, ""), (None, "x"), (1, "again")]
    src = docs(rows).repartition(3, "doc_id").checkpoint()
    path, written = order.materialise(src, seq_len=32, shard_slots=10, key=5)
    got = sorted(written.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(len(got)))
    assert all(len(r["ids"]) == 64 and r["shard"] == r["slot"] // 10 and r["byte_offset"] == 64 * (r["slot"] % 10) for r in got)
    n = len(got)
    assert order.feistel(np.array([r["number"] for r in got]), n, 5).tolist() == list(range(n))
    lib = Tokenizer.from_file(tokens.default_path())
    want = sorted(lib.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows)
    stream, docs_back, cur = [], [], []
    for r in sorted(got, key=lambda r: r["number"]):
        stream += np.frombuffer(r["ids"], "<u2")[:r["n_ids"]].tolist()
    for x in stream:
        cur.append(x)
        if x == 2:
            docs_back.append(cur)
            cur = []
    assert sorted(docs_back) == want
    part = order.read_slots(spark, path, 7, 9, shard_slots=10).collect()
    assert [r["slot"] for r in part] == list(range(7, 16))
    assert order.index_of(written).where(F.col("ids_crc32").isNull()).count() == 0


def test_slots_by_column_and_no_rows(spark, docs):
    got = [r["s"] for r in spark.range(50).select(order.slot_of(F.col("id"), 50, 5).alias("s")).collect()]
    assert got == order.feistel(np.arange(50), 50, 5).tolist()
    _, none = order.materialise(docs([]))
    assert none.count() == 0


def test_order_follows_from_data_and_key_whatever_the_splits(spark, docs):
    rows = [(i % 40 if i % 7 else None, " ".join(f"w{(i * j) % 13}" for j in range(i % 60))) for i in range(150)] + [(3, "same")] * 5
    a = order.materialise(docs(rows).repartition(5), seq_len=32, shard_slots=8, key=1)[1]
    b = order.materialise(docs(rows[::-1]).repartition(2), seq_len=32, shard_slots=8, key=1)[1]
    cols = ["slot", "number", "n_ids", "first_doc", "first_start", "last_doc", "ids"]
    got = [sorted((tuple(r) for r in x.select(cols).collect()), key=lambda r: r[0]) for x in (a, b)]
    assert got[0] == got[1]
    assert sum(r[2] < 32 for r in got[0]) <= 1  # one padded sequence in all


def test_binary_shards_are_read_by_a_seek(spark, docs, tmp_path):
    _, written = order.materialise(docs([(i, f"text {i} " * 9) for i in range(60)]), seq_len=16, shard_slots=7)
    order.write_binary(written, f"{tmp_path}/bin")
    for r in written.collect():
        (file,) = (tmp_path / "bin" / f"shard={r['shard']}").glob("part-*")
        assert order.read_record(str(file), r["record"], 16).tobytes() == bytes(r["ids"])


def test_long_documents_nulls_and_empty_texts(spark, docs):
    rows = [(1, "a b c " * 3000), (2, None), (2, ""), (None, None), (None, "x")]
    _, written = order.materialise(docs(rows), seq_len=64)
    got = sorted(written.collect(), key=lambda r: r["number"])
    assert [r["number"] for r in got] == list(range(len(got)))
    lib = Tokenizer.from_file(tokens.default_path())
    assert sum(r["n_ids"] for r in got) == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    long = [r for r in got if r["first_doc"] == 1 and r["first_start"]]
    assert all(b["first_start"] - a["first_start"] == 64 for a, b in zip(long, long[1:]))


def test_words_of_other_case_or_end_are_tokenised_once(monkeypatch):
    import pyarrow as pa
    seen, word = [], tokens.Encoder._word
    monkeypatch.setattr(tokens.Encoder, "_word", lambda self, w: (seen.append(w), word(self, w))[1])
    enc, lib = tokens.Encoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    text = "House house. HOUSE, größe... Größe (house"
    for _ in range(2):
        ids, _ = enc.encode(pa.array([text]))
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert sorted(seen) == ["", "(house", ",", ".", "...", "größe", "house"]


@pytest.mark.parametrize("cap", [0, 3, 1000])
def test_parted_words_equal_the_library_whatever_is_kept(monkeypatch, cap):
    import random

    import pyarrow as pa
    monkeypatch.setattr(tokens, "_CACHE_WORDS", cap)
    enc, lib = tokens.Encoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    draw = random.Random(7)
    signs = "aAzZéÉßÞ09'\"<|>.,!-_…—̸́ﬁΣσİ日🙂\x0b\x7f  \n\t"
    rows = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 30))) for _ in range(400)]
    rows += ["don't! we'll. 's 's. it's' a.'s, <|endoftext|>. x<|. A.'S...", "", None]
    for part in (rows[:200], rows[200:], rows):
        ids, at = enc.encode(pa.array(part), eos=2)
        assert len(enc.known) <= cap
        for i, r in enumerate(part):
            assert ids[at[i]:at[i + 1]].tolist() == lib.encode(r or "", add_special_tokens=False).ids + [2]
