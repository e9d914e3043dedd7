import numpy as np

from formlens.llm.ball_search import build_tree, quantised, search_tree, top_k
from formlens.llm.common import Scratch


def test_tree_search_equals_brute_force():
    rnd = np.random.default_rng(2)
    values = rnd.integers(-300, 300, (700, 8))
    values[100:160] = values[0]
    ids = rnd.permutation(700)
    tree = build_tree(ids, values, leaf=16)
    q = np.r_[values[:20], rnd.integers(-300, 300, (20, 8))]
    qid = np.r_[ids[:20], np.arange(1000, 1020)]
    got = {}
    for query, v, s in search_tree(tree, qid, q, 7):
        got.setdefault(query, []).append((-s, v))
    for i, query in enumerate(qid):
        truth = sorted((-int(values[j] @ q[i]), int(ids[j])) for j in range(700) if ids[j] != query)[:7]
        assert sorted(got[int(query)]) == truth


def test_top_k_with_odd_rows(spark):
    rows = [(i, [float(i % 7) / 9, -float(i % 5) / 3, 0.1]) for i in range(300)] + [(1000, None), (1001, [1.0, None, 2.0]), (1002, [float("nan"), 1.0, 1.0]), (1003, [float("inf"), 1.0, 1.0]), (1004, [1e9]), (1005, []), (None, [1.0, 1.0, 1.0]), (7, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "'x' as score")
    v = quantised(df)
    got = top_k(v, v.filter("vec_id % 50 = 0"), Scratch(spark, "t"), k=5, shard_rows=64, block=3).collect()
    data = [(i, [int(np.floor(1024 * x)) for x in e] + [0] * (3 - len(e))) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    for q in range(0, 300, 50):
        own = next(e for i, e in data if i == q)
        truth = sorted((-sum(a * b for a, b in zip(own, e, strict=True)), i) for i, e in data if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == truth
    assert top_k(v.limit(0), v.limit(0), Scratch(spark, "t")).collect() == []
    alone = v.filter("vec_id = 0")
    assert top_k(alone, alone, Scratch(spark, "t")).collect() == []


def test_huge_components_stay_exact(spark):
    v = spark.createDataFrame([(0, [2**40, 3]), (1, [2**20, 1]), (2, [2**20, 2])], "vec_id long, v array<bigint>")
    got = top_k(v, v.filter("vec_id = 0"), Scratch(spark, "t")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 2**60 + 6), (1, 2**60 + 3)]
