import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chorus.llm import suffix


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(200):
        n, a = rng.randint(1, 150), rng.choice([1, 2, 3, 250])
        t = np.array([rng.randint(0, a) for _ in range(n)], np.uint16)
        assert suffix.suffix_array(t, 10 ** 4).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_repeated_starts_equal_counting():
    rng = random.Random(2)
    for _ in range(150):
        length = rng.choice([8, 9, 13])
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        c = Counter(p[i:i + length] for p in parts for i in range(len(p) - length + 1))
        got = suffix.repeated_starts(parts, length)
        assert [m.tolist() for m in got] == [[c[p[i:i + length]] > 1 for i in range(max(0, len(p) - length + 1))] for p in parts]


def cut_segments(texts, length, gram):
    """(anchor hash, bytes, place of the anchor) of the different segments of all texts."""
    out = set()
    for b in texts:
        raw = np.frombuffer(b, np.uint8)
        h, start, count, at = suffix.segments(raw, np.full(len(raw), len(raw)), length, gram)
        out |= {(int(x), b[s:s + n - 1 + length], int(a - s)) for x, s, n, a in zip(h, start, count, at)}
    return sorted(out)


def test_aligned_starts_equal_counting():
    rng = random.Random(4)
    for k in range(200):
        length, gram = rng.choice([(8, 4), (13, 4), (16, 5)])
        base = bytes(rng.choice(b"abc" if k % 2 else b"\0\1") for _ in range(80))
        texts = [base[rng.randint(0, 40):rng.randint(40, 80)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) + base[rng.randint(0, 60):]
                 for _ in range(rng.randint(1, 8))]
        rows = cut_segments(texts, length, gram)
        parts = [x for _, x, _ in rows]
        group = np.cumsum([0] + [a[0] != b[0] for a, b in zip(rows, rows[1:])])[:len(rows)]
        c = Counter((h, x[i:i + length]) for h, x, _ in rows for i in range(len(x) - length + 1))
        got = suffix.repeated_starts(parts, length, np.array([at for _, _, at in rows], np.int64), group)
        assert [m.tolist() for m in got] == [[c[h, x[i:i + length]] > 1 for i in range(len(x) - length + 1)] for h, x, _ in rows]


def test_one_suffix_of_a_segment_is_sorted(monkeypatch):
    rng = random.Random(6)
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    shared = word(500)
    rows = cut_segments([word(300) + shared[i:] + word(300) for i in range(20)], 64, 20)
    sorted_places, real = [], suffix._sort_places
    monkeypatch.setattr(suffix, "_sort_places", lambda keys, s, depth: sorted_places.append(len(s)) or real(keys, s, depth))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([hashlib.md5(r[1]).digest() for r in rows], pa.binary()),
                                        pa.array([r[2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                       names=["h", "dig", "rel", "bytes"])
    marked = sum(b.num_rows for b in suffix._sorted_groups(64)(iter([batch])))
    assert sorted_places == [len(rows)] and marked > 0


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    c = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if c[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)]
    rows = []
    for i in range(150):
        body = [text(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            body += [rng.choice(shared)[rng.randint(0, 30):], text(rng.randint(0, 20))]
        rows.append((i, " ".join(body)))
    base = rows[3][1] + text(80)
    rows += [(200 + i, base[:100 + i] + "x" + base[101 + i:]) for i in range(12)]  # near copies
    rows += [(300, rows[7][1]), (301, None), (302, ""), (303, "a" * 500), (304, shared[0] * 3), (7, rows[7][1]), (None, rows[9][1])]
    return rows


@pytest.mark.parametrize("max_group", [4096, 2])  # 2: nearly every anchor takes the way of the large ones
def test_removed_bytes_equal_brute_force(spark, docs, max_group):
    rows = corpus()
    cut = suffix.drop_repeats(docs(rows).repartition(3, "doc_id"), length=64, gram=20, max_group=max_group)
    got = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
           for r in cut.collect()]
    assert sorted(got, key=str) == brute(rows, 64)


def test_long_documents_are_cut_into_slices(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix, "_SLICE", 700)
    raw = np.frombuffer(corpus()[5][1].encode() * 9, np.uint8)
    seen = set()
    for part, cuts, rows, base in suffix._slices(raw, np.array([0, len(raw)]), 64):
        which = np.repeat(np.arange(len(rows)), np.diff(cuts))
        h, start, count, at = suffix.segments(part, cuts[1:][which], 64, 20)
        for s, n in zip(start + base[0], count):
            seen.update(range(s, s + n))
    assert seen == set(range(len(raw) - 63))


def test_text_stage_keeps_columns(spark, docs):
    df = docs([(1, "é" * 100 + "unique one"), (2, "é" * 100 + "another"), (3, None), (4, "")]).withColumnRenamed("size", "n_chars")
    got = {r["doc_id"]: r for r in suffix.cut_repeats(df, length=64).collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == ["unique one", "another", None, ""]
    assert got[1]["n_chars"] == 10 and got[3]["n_chars"] == -7
    assert suffix.drop_repeats(docs([])).count() == 0
