import random
import re

import numpy as np
import pytest

from chorus.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    s = [shingles(t, k) for _, t in rows]
    par = list(range(len(rows)))

    def find(a):
        while par[a] != a:
            a = par[a]
        return a
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j]:
                both = len(s[i] & s[j])
                if 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                    a, b = find(i), find(j)
                    par[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s[i]), low.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, n = [], 0
    for size, edits in [(1, 0)] * 60 + [(2, 1), (3, 2), (5, 3), (8, 6), (40, 5), (30, 9)]:
        base = text(rng.choice([3, 4, 9, 25, 80, 150]) if size < 8 else 120)
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    passage = " ".join(text(60))
    rows += [(500 + i, passage + " " + " ".join(text(50))) for i in range(20)]
    rows += [(700, rows[0][1].upper()), (701, None), (702, ""), (703, "one"), (704, "One"), (705, " \t"), (None, rows[1][1]),
             (1, rows[2][1]), (1, rows[1][1]), (1, rows[1][1])]
    return rows


@pytest.mark.parametrize("k,percent,chunk", [(4, 85, 400_000), (5, 80, 400_000), (4, 85, 900), (2, 50, 700)])
def test_components_equal_all_pairs(spark, docs, k, percent, chunk):
    rows = corpus()
    got, _ = jaccard.jaccard_classes(docs(rows).repartition(3, "doc_id"), k, percent, chunk=chunk)
    res = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str)
    assert res == brute(rows, k, percent)


def test_sets_at_the_threshold_share_a_signature():
    rng = np.random.default_rng(1)
    for percent in (50, 80, 85, 95):
        for _ in range(150):
            n = int(rng.integers(1, 300))
            base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a = np.unique(base[:n])
            cut = int(rng.integers(0, n + 1))
            b = np.unique(np.concatenate([a[cut:], base[n:n + int(rng.integers(0, n + 1))]]))
            if not len(b):
                continue
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)))


def test_stage_keeps_one_of_each_group(spark, docs):
    rows = corpus()
    df = docs(rows)
    left = jaccard.drop_near_copies(df, k=5, percent=80)
    assert left.columns == df.columns
    comp = {}
    full, _ = jaccard.jaccard_classes(df, 5, 80)
    for r in full.collect():
        comp[r["doc_id"]] = r["component_id"]
    ids = [r["doc_id"] for r in left.collect()]
    assert set(i for i in ids if i is not None) == {c for c in comp.values() if c is not None and c in comp and comp[c] == c}
    assert jaccard.drop_near_copies(docs([])).count() == 0


def test_signatures_leave_the_disk_and_blocks_are_joined_in_slices(spark, docs, monkeypatch):
    tables, real = [], jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, name: tables.append(real(df, name)) or tables[-1])
    jaccard.jaccard_classes(docs(corpus()), 4, 85, chunk=900)
    left = []
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        left += [t] * path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert left and not any("text" in t.columns or any(kind == "array<bigint>" for _, kind in t.dtypes) for t in left)
    assert sum(t.columns == ["pivot", "cid"] for t in left) > 1 and sum(t.columns == ["a", "b"] for t in left) > 1
