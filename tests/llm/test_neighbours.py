import math

import numpy as np
import pytest

from chorus.llm import neighbours


def brute(rows, threshold):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    d = max((len(v) for _, v in ok), default=0)
    x = np.array([np.pad(v, (0, d - len(v))) / np.linalg.norm(v) for _, v in ok]).reshape(-1, max(d, 1))
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    par = list(range(len(ok)))

    def find(a):
        while par[a] != a:
            a = par[a]
        return a
    for a, b in zip(*np.nonzero(hit)):
        ra, rb = find(a), find(b)
        par[max(ra, rb)] = min(ra, rb)
    low = {}
    for i in range(len(ok)):
        low[find(i)] = min(low.get(find(i), 1 << 60), ok[i][0])
    return {ok[i][0]: (int(hit[i].sum()), low[find(i)]) for i in range(len(ok))}


def cloud(seed=0):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for size in [1] * 300 + [2] * 30 + [15] * 6 + [90]:
        base = rng.standard_normal(16)
        for _ in range(size):
            rows.append((n, (base + 0.08 * rng.standard_normal(16)).tolist()))
            n += 1
    rows += [(n, rows[5][1]), (n + 1, rows[5][1]), (n + 2, [2 * x for x in rows[-1][1]])]
    return rows


@pytest.mark.parametrize("whole", [1024, 40])  # 40: the group of 90 goes through its mean's ball and blocks
def test_links_and_components_equal_brute_force(spark, whole):
    rows = cloud()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got, audit = neighbours.near_vectors(df, 0.95, block=64, whole=whole)
    want = brute(rows, 0.95)
    res = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()}
    found, true = sum(v[0] for v in res.values()), sum(v[0] for v in want.values())
    assert audit["recall"] >= 0.9 and 0.98 * true <= found <= true
    assert all(res[i][0] <= want[i][0] for i in want)
    assert sum(res[i] != want[i] for i in want) <= 0.02 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("block", [64, 2])  # 2: no block sees both groups whole, the means must find them
def test_groups_with_full_lists_still_find_each_other(spark, block):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(4):
        a, b = np.linalg.qr(rng.standard_normal((24, 2)))[0].T
        for centre in (a, 0.96 * a + 0.28 * b):  # two tight groups at cosine 0.96
            for _ in range(14):
                rows.append((n, (centre + 0.003 * rng.standard_normal(24)).tolist()))
                n += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.near_vectors(df, 0.95, block=block, trees=8 if block == 2 else 3)[0]
    want = brute(rows, 0.95)
    assert len({c for _, c in want.values()}) == 4
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()} == want


def test_recall_counts_rows_not_links(spark):
    rng = np.random.default_rng(4)
    big, rows = rng.standard_normal(16), []
    rows += [(i, (big + 0.02 * rng.standard_normal(16)).tolist()) for i in range(150)]
    for i in range(75):
        base = rng.standard_normal(16)
        rows += [(200 + 2 * i + j, (base + 0.08 * rng.standard_normal(16)).tolist()) for j in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 0.95)
    got, audit = neighbours.near_vectors(df, 0.95, trees=1, rounds=0, block=16)
    res = {r["vec_id"]: r["n_links"] for r in got.collect()}
    pairs = [i for i in want if i >= 200 and want[i][0]]
    assert sum(res[i] >= want[i][0] for i in pairs) >= 0.95 * len(pairs) and audit["orders"] > 1
    with pytest.raises(RuntimeError, match="recall"):
        neighbours.near_vectors(df, 0.95, recall=1.01, attempts=1)


def test_edge_vectors(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 0.0]), (6, [2.0]), (7, [float("inf"), 1.0]),
            (8, [1e300, 0.0]), (5, [1.0, 0.0]), (None, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_vectors(df)[0].collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 3, 5, True), (5, 3, 5, True), (6, 3, 5, False),
            (7, 0, 7, True), (8, 3, 5, False), (None, 0, None, False)]
    assert got == sorted(want, key=str)
    assert neighbours.near_vectors(df.limit(0))[0].count() == 0
