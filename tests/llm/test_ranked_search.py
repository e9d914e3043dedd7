import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from formlens.llm.common import Scratch
from formlens.llm.ranked_search import build_treap, ranked_search, read_treap, search_treap

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    counts = [(doc, c, sum(c.values())) for doc, c in counts if c]
    n_docs, total = len(counts), sum(n for *_, n in counts)
    df, asked, out = Counter(t for _, c, _ in counts for t in c), {}, []
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, want in asked.items():
        found = []
        for doc, c, n in counts:
            m = 100 - 90 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in want if t in c)
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, i, doc, -s) for i, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, parts=3, **options):
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked_search(d, q, Scratch(spark, "ranked"), **options).collect()), key=repr)


def test_against_brute_force(spark):
    draw = np.random.default_rng(4)
    vocab = np.array([f"Word{i}" for i in range(80)] + ["été", "Ünï", "x9"])
    weight = 1 / np.arange(1, 84)
    text = lambda n: " ".join(draw.choice(vocab, n, p=weight / weight.sum())) + ", _-" * int(draw.integers(2))
    docs = [(i, text(int(draw.integers(0, 60)))) for i in range(300)] + [(1000 + i, "word3 word7 copies " * 4) for i in range(100)]
    items = [(i, text(int(draw.integers(0, 12)))) for i in range(30)] + [(90, "copies")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, parts=1, k=3) == brute(docs, items, 3)


@pytest.mark.parametrize("seed", range(6))
def test_treap_keeps_points_and_finds_the_best(seed):
    draw = np.random.default_rng(seed)
    rows, cols = (int(x) for x in draw.integers(1, 70, 2))
    grid = (draw.random((rows, cols)) < draw.random() / 2) * draw.integers(1, 30, (rows, cols))
    grid[0, 0] = 3
    r, c = np.nonzero(grid)
    height = max(rows - 1, cols - 1).bit_length()
    stored = build_treap(r, c, grid[r, c], height)
    treap = read_treap(height, *(stored[x] for x in ("mask", "delta", "down", "across")))
    assert sorted(zip(treap.row.tolist(), treap.col.tolist(), treap.value.tolist(), strict=True)) == sorted(zip(r.tolist(), c.tolist(), grid[r, c].tolist(), strict=True))
    ids = np.sort(draw.integers(0, 500, cols))
    for _ in range(10):
        asked, weight = draw.permutation(rows)[: int(draw.integers(1, 8))], draw.integers(0, 5, 8)
        weight = weight[: len(asked)]
        score = (grid[asked] * weight[:, None]).sum(0)
        want = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if s > 0)[:5]
        assert search_treap(treap, ids, asked, weight, 5, [])[0] == want


def test_ranges_below_the_kth_score_stay_closed():
    """One rare document among many: with the k-th score known, most of the shard isn't opened."""
    n = 4096
    row, col = np.r_[np.zeros(n, int), [1]], np.r_[np.arange(n), [77]]
    stored = build_treap(row, col, np.r_[np.arange(n) % 50 + 1, [1000]], 12)
    treap = read_treap(12, *(stored[x] for x in ("mask", "delta", "down", "across")))
    best, opened = search_treap(treap, np.arange(n), np.array([0, 1]), np.array([1, 9]), 1, [])
    assert best == [(-(9000 + 77 % 50 + 1), 77)] and opened < 600
    assert search_treap(treap, np.arange(n), np.array([0, 1]), np.array([1, 9]), 1, [(-10_001, 5)]) == ([(-10_001, 5)], 0)


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (2, "alpha beta"), (2, "alpha beta"), (3, "!!! --"), (4, "alpha " * 50_000), (5, "İ ß alpha")]
    items = [(1, "Alpha, beta"), (1, "ß"), (2, None), (3, "unknown"), (None, "BETA")]
    assert run(spark, docs, items) == brute(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("terms", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    full = ranked_search(d, q, Scratch(spark, "odd"))
    assert full.count() == len(brute(docs, items))
    for left, right in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0))):
        none = ranked_search(left, right, Scratch(spark, "none"))
        assert none.count() == 0 and none.columns == full.columns
