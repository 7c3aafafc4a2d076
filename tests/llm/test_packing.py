import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from chorus.llm import packing, tokens

WORDS = ["loser", "thor,", "Naïve", "été", "it's", "x1", "größe!", "日本語", "🙂", "<|endoftext|>", "a_b", "ΟΔΟΣ"]


def text(i, n):
    return " ".join(WORDS[(i * 7 + j * j) % len(WORDS)] + ("\n" if j % 9 == 0 else "") for j in range(n))


def test_encoder_equals_the_library():
    enc, lib = tokens.encoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    import pyarrow as pa
    rows = [text(i, 30 * i) for i in range(8)] + ["", None, "  \t\n ", "Å K ﬁ ½ ² İstanbul", "\x00\x01 a\x7fb"]
    ids, at = enc.encode(pa.array(rows), eos=2)
    lens = enc.lengths(pa.array(rows))
    for i, r in enumerate(rows):
        want = lib.encode(r or "", add_special_tokens=False).ids
        assert ids[at[i]:at[i + 1]].tolist() == want + [2]
        assert lens[i] == len(want)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 100, 128, 1365, 2048, 2049, 4000, 4095, 4096, 4097, 9000])
def test_cuts_cover_and_stay_near_their_class(n):
    parts = packing.cuts(n, 4096, 0.01, 64)
    assert sum(parts) == n and min(parts) >= 1 and max(parts) <= 4096
    for p in parts:
        if p > 64:
            assert 4096 - (4096 // p) * p <= 0.03 * 4096


def check(df, rows, capacity):
    lib = Tokenizer.from_file(tokens.default_path())
    got = [r.asDict() for r in df.collect()]
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc, t in rows:
        want = lib.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            part = np.array(want[at:at + r["length"]], "<u4")
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            assert np.frombuffer(r["ids"], f"<u{r['id_bytes']}").tolist() == part.tolist()
            at += r["length"]
        assert at == len(want)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and all(r["sequence_length"] == at for r in rs)
    return by_seq


def test_every_id_lies_in_one_piece(docs):
    rows = [(i, text(i, (i * 37) % 400)) for i in range(60)] + [(100, None), (101, ""), (102, text(3, 6000))]
    df = packing.harmonic_pack(docs(rows).repartition(5, "doc_id"), capacity=512, fan_in=2)
    seqs = check(df, rows, 512)
    total = sum(r["length"] for rs in seqs.values() for r in rs)
    assert len(seqs) * 512 <= total * 1.05 + 512  # little padding


def test_repeated_rows_null_ids_and_no_rows(docs):
    df = packing.harmonic_pack(docs([(1, "a b"), (1, "a b"), (None, "a b")]), capacity=8)
    got = df.groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {1: 6, None: 3}
    assert packing.harmonic_pack(docs([])).count() == 0
