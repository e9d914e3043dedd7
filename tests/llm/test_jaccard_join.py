import random
import re

import numpy as np
import pyarrow as pa
import pytest

from formlens.llm.common import Scratch
from formlens.llm.components import connected_components
from formlens.llm.jaccard_join import Bands, near_duplicates, signatures, sketch, sketch_distance
from formlens.llm.textkernel import shingle_sets, words


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=80):
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * both:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choices(vocabulary, k=30))
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(texts).split(" ")
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rnd.randrange(len(w))
                w[at : at + rnd.choice([0, 1])] = [rnd.choice(vocabulary)]
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 5, 8, 20, 60, 150]))) + rnd.choice(["", " " + passage]))
    return list(enumerate(texts, 10))


@pytest.mark.parametrize(("seed", "limit"), [(1, 24), (2, 2)])
def test_equals_brute_force(spark, seed, limit):
    rows = corpus(seed, 160)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), group_limit=limit).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, " \n\t", 7), (4, "One two", 8), (5, "one  TWO", 9), (None, "one two", 1), (5, "one  TWO", 2), (6, "ÉÉ two", 3), (7, "x " * 20000, 4), (8, "x " * 19999, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in near_duplicates(df, Scratch(spark, "t")).collect())
    assert got == sorted(map(str, [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, None), (6, 1, 6), (7, 1, 7), (8, 1, 7)]))
    assert near_duplicates(df.limit(0), Scratch(spark, "t")).collect() == []


def test_signatures_meet_and_sketch_is_sound():
    bands, rnd = Bands(80), np.random.default_rng(3)
    for n in (5, 9, 17, 37, 60, 333, 1200):
        for _ in range(20):
            a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
            d = 2 * len(a) // 18
            b = np.unique(np.r_[a[d // 2 :], rnd.integers(0, 1 << 63, d // 2).astype(np.uint64)])
            if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
                continue
            tag = max(bands.of(len(a)), bands.of(len(b)))
            for family in range(bands.parts(tag)[2]):
                (x, sx), (y, sy) = signatures(a, bands, tag, family), signatures(b, bands, tag, family)
                assert len(np.intersect1d(x, y)) >= max(sx, sy)
            assert sketch_distance(sketch(a), sketch(b)) <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))


@pytest.mark.parametrize("percent", [50, 99, 100])
def test_other_thresholds(spark, percent):
    words = [f"w{i}" for i in range(1500)]
    texts = [words, [*words[:700], "new", *words[701:]], words[1:], words[:1000], ["x"], words]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, percent)


def test_a_large_group_of_near_copies(spark):
    """Frequent signatures: a chain of sets of which far ones don't link, and sets that share a passage only."""
    rnd, words = random.Random(5), [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        if i % 10 == 9:
            words = words[2:] + [f"v{i}", f"u{i}"]
        rows.append((i, " ".join([*words, *rnd.choices("abcdef", k=2)])))
    rows += [(1000 + i, " ".join(words[:25] + [f"own{i}x{j}" for j in range(40)])) for i in range(60)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), group_limit=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_words_of_a_regular_structure_differ(spark):
    """Thue-Morse words, which collide in every polynomial hash over a power of two."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    w = words(pa.array([a, b]))
    assert w.hash[0] != w.hash[1]
    got = near_duplicates(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2)}


def test_kernel_words():
    w = words(pa.array(["Ab  c\x0bD", "", "é É", "a"]))
    assert np.diff(w.first).tolist() == [3, 0, 2, 1]
    assert w.hash[3] != w.hash[4] and len(list(shingle_sets(w))) == 4


def test_components_of_a_chain(spark):
    edges = spark.range(0, 40).selectExpr("id as u", "id + 1 as v").union(spark.createDataFrame([(100, 90), (5, 5), (None, 3)], "u long, v long"))
    got = {r.node: r.component for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}


def test_hot_keys_are_spread_over_tasks(spark):
    """A key with a third of the rows: the join is whole, and no task of its stage gets over twice the median of the others."""
    from pyspark.sql import functions as F

    from formlens.llm.common import Scratch, spread_join

    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000 + 10).alias("a"), F.col("id").alias("b"))
    table = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") * 2).alias("v"))
    out = spread_join(rows, table, "a", "b", Scratch(spark, "spread"), "t", hot_parts=64)
    assert {(r.a, r.b, r.v) for r in out.collect()} == {(r.a, r.b, 2 * r.a) for r in rows.collect()} and out.count() == 30_000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = [r["n"] for r in spread_join(rows, table, "a", "b", Scratch(spark, "spread"), "t", hot_parts=64).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(tasks) < 2.5 * sorted(tasks)[len(tasks) // 2]
    plain = spread_join(rows.filter("a <> 7"), table, "a", "b", Scratch(spark, "spread"), "t")
    assert plain.count() == 20_000


def test_a_set_is_sent_once_for_all_its_signatures_in_a_bucket():
    import pyarrow as pa

    from formlens.llm import jaccard_join as j

    text = [" ".join(f"w{i}" for i in range(n)) for n in (7, 400, 900)]
    run, _ = j._signature_rows(5, j.Bands(80), 1, 0)
    rows = [r for b in run(iter([pa.record_batch([pa.array([0, 1, 2]), pa.array(text)], names=["doc_id", "text"])])) for r in b.to_pylist()]
    sent, signed = sum(len(r["key"]) // 8 for r in rows), sum(len(r["high"]) for r in rows)
    assert signed == sum(sum(r["count"]) for r in rows) and signed > 1000 and sent * 20 < signed


def packed_bucket(rnd, rows, sets, signatures_of_a_set, of=None):
    """Batches of one bucket as ``_signature_rows`` makes them, and the (signature, key) pairs in them."""
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("sig", "high", "count", "key", "slack", "tag"))])
    made, known = [], []
    for _ in range(rows):
        key = rnd.integers(0, 1 << 40, sets)
        sig = rnd.integers(1 << 20, 1 << 40, sets * signatures_of_a_set) if of is None else rnd.choice(of, sets * signatures_of_a_set)
        known += zip(sig.tolist(), np.repeat(key, signatures_of_a_set).tolist(), strict=True)
        made.append((7, sig.astype(np.uint32).tobytes(), (sig >> 32).astype(np.uint8).tobytes(), bytes([signatures_of_a_set] * sets), key.tobytes(), bytes([3] * sets), np.full(sets, 90, np.uint16).tobytes()))
    table = pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
    return table.to_batches(max_chunksize=10), known


def test_a_bucket_of_signatures_takes_little_memory():
    import tracemalloc

    from formlens.llm import jaccard_join as j

    batches, known = packed_bucket(np.random.default_rng(1), 100, 100, 50)
    tracemalloc.start()
    try:
        assert not sum(len(b) for b in j._collisions(24)(iter(batches)))
        assert tracemalloc.get_traced_memory()[1] < 40 * len(known)
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("held", [1 << 22, 500])
def test_slices_of_a_bucket_lose_no_pair(monkeypatch, held):
    """Signatures of up to three sets give all pairs, others connect their sets and are counted, in one go and with thinning out."""
    from formlens.llm import jaccard_join as j

    monkeypatch.setattr(j, "HELD", held)
    monkeypatch.setattr(j, "STRETCH", 100)
    rnd = np.random.default_rng(2)
    of = rnd.integers(1 << 20, 1 << 40, 900)
    batches, known = packed_bucket(rnd, 60, 8, 4, np.r_[of, np.repeat(of[:3], 100)])
    rows = [r for b in j._collisions(3)(iter(batches)) for r in b.to_pylist()]
    pairs = {(r["a"], r["b"]) for r in rows if r["b"] is not None}
    sets, counts = {}, {}
    for s, k in known:
        sets.setdefault(s, set()).add(k)
    for r in rows:
        if r["b"] is None:
            counts[r["a"]] = counts.get(r["a"], 0) + r["hot"]
    for members in sets.values():
        if len(members) <= 3:
            assert all((a, b) in pairs for a in members for b in members if a < b)
        else:
            reached, todo = set(), [min(members)]
            while todo:
                x = todo.pop()
                if x not in reached:
                    reached.add(x)
                    todo += [y for y in members if (min(x, y), max(x, y)) in pairs]
            assert reached == members
    if held > len(known):
        assert counts == {k: n for k in {k for _, k in known} if (n := sum(k in m and len(m) > 3 for m in sets.values()))}


def test_memory_is_given_back_when_the_last_batch_is_gone(monkeypatch):
    import weakref

    from formlens.llm import jaccard_join as j
    from formlens.llm import textkernel

    held, seen = [], []

    def batches():
        made, _ = packed_bucket(np.random.default_rng(3), 1, 10, 5, np.array([1 << 30]))
        held.append(weakref.ref(made[0]))
        yield made.pop()

    monkeypatch.setattr(textkernel, "release", lambda: seen.append(held[-1]() is None))
    assert sum(len(b) for b in j._collisions(24)(batches())) > 0
    assert seen == [True]


def test_texts_come_in_small_batches(spark):
    from formlens.llm.common import small_batches

    def size(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    df = spark.range(3000, numPartitions=1).selectExpr("repeat('x', 10000) as text").mapInArrow(size, "n long")
    whole = [r.n for r in df.collect()]
    with small_batches(spark, "1m"):
        parts = [r.n for r in df.collect()]
    assert max(whole) > 20_000_000 > 4_000_000 > max(parts) and [r.n for r in df.collect()] == whole
