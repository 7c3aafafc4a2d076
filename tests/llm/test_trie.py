import hashlib
import random

import pytest
from brute import trie as brute_trie

from chorus.llm import trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth long, holder int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", -1, -2) for r in rows], SCHEMA)


def nodes(spark, rows, **params):
    out, ends = trie.prefix_trie(table(spark, rows), **params)
    out = out.join(trie.ends_hash(ends), "key", "left").collect()
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                                        r["ends_sha256"] or hashlib.sha256(b"").hexdigest()) for r in out}
    assert len(got) == len(out)
    return got


def corpus(n, seed):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(n * 3), n):
        for t in range(rng.choice([0, 1, 1, 2, 3, 6, 9])):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None, ""]),
                         rng.choice(["a", "b", "é🙂", "", None, "long " * 50])))
    rows += rng.sample(rows, min(len(rows), 12))  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(120, seed)
    assert nodes(spark, rows) == brute_trie(rows)


def test_without_rebuilding_copies_and_prefixes_collapse(spark):
    rows = [(c, t, "user", x) for c, text in enumerate(["ab", "ab", "a", "abc", "x", ""]) for t, x in enumerate(text)]
    got = nodes(spark, rows, heads=1)
    assert got == brute_trie(rows, heads=1)
    assert got[(0, 0)][1:4] == (5, 2, 2)
    assert got[(0, 1)][1:5] == (4, 1, 1, 5)  # a: 4 members, (4 - 1) + (3 - 1) + 0


def test_one_conversation_fills_many_partitions_and_a_copied_one_is_most_of_the_table(spark):
    rows = [(100, t % 97, "user", f"turn {t % 50}") for t in range(150)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1100) for t in range(2)]
    rows += [(7, None, None, None)] * 20
    assert nodes(spark, rows, heads=1) == brute_trie(rows, heads=1)


def test_turnless_null_ids_and_empty_table(spark):
    # conversation 105 has one turn, which its absent base's head replaces
    import zlib
    c = next(i for i in range(101, 199) if zlib.crc32(str(i).encode()) % 6 > 0)
    rows = [(c, 0, "user", "only"), (None, 0, "user", "nobody"), (None, None, None, None)]
    assert nodes(spark, rows) == {(c, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}
    assert nodes(spark, []) == {}


def test_negative_ids_and_last_turns(spark):
    rows = [(c, t, "user", f"{c % 7} {t}") for c in (-305, -300, -301, -1, 0, 1, 99) for t in range(4)]
    assert nodes(spark, rows) == brute_trie(rows)
    out, _ = trie.prefix_trie(table(spark, rows))
    got = trie.with_turns(out, table(spark, rows)).where(F.col("depth") == 1).select("conv_id", "last_text").collect()
    assert {(r[0], r[1]) for r in got} <= {(r["conv_id"], f"{c % 7} 0") for r in got for c in (-305, -300, -301, -1, 0, 1, 99)}
    assert all(r[1] for r in got)


def test_end_lists_hold_every_member_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "_CHUNK", 16)
    rows = [(c, 0, "user", "hi") for c in range(500)]
    _, ends = trie.prefix_trie(table(spark, rows), heads=1)
    got = sorted(ends.collect(), key=lambda r: r["first"])
    assert ",".join(r["ids"] for r in got) == ",".join(map(str, range(500)))
