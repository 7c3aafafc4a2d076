import math
import random

from chorus.llm import topk
from chorus.llm.common import stage


def brute(rows, qs, k):
    ok = sorted({(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
                 if v is not None and all(x is not None and math.isfinite(x) for x in v)}, key=str)
    out = {}
    for q, qv in ok:
        if q in qs:
            s = [(-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q]
            out[q] = [(i, -x) for x, i in sorted(s, key=lambda t: (t[0], t[1] is None, t[1] or 0))[:k]]
    return out


def run(spark, rows, k=10, **params):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    t = stage(topk.quantised(df), "t")
    got = {}
    for r in sorted(topk.top_k(t, t.where("vec_id % 10 = 0"), k, **params).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_equals_brute_force_with_ties_and_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(rng.choice([12, 12, 12, 5]))]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (410, [float("inf")]), (None, [1.0] * 12), (20, rows[20][1])]
    want = brute(rows, set(range(0, 420, 10)), 10)
    assert run(spark, rows) == want
    assert run(spark, rows, query_block=7, lists=3) == want


def test_huge_values_few_rows_and_no_rows(spark):
    rows = [(0, [1e6, -1e6]), (1, [1e6, 1.0]), (2, [-1e6, 1e6]), (10, [3e5, 2.0])]
    assert run(spark, rows) == brute(rows, {0, 10}, 10)
    assert run(spark, []) == {} and run(spark, [(1, [1.0])]) == {} and run(spark, [(10, [1.0])]) == {}
