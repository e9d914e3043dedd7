import random

import pytest

from formlens.llm.common import Scratch
from formlens.llm.line_dedup import dedup_lines


def brute(rows, least):
    """Delete a line if some run through it of ``least`` words stands earlier."""
    docs = [(d, t.split("\n")) for d, t in sorted((d, t) for d, t in rows if t)]
    words = lambda line: line.count(" ") + 1 if line else 0
    places = [(a, i) for a in range(len(docs)) for i in range(len(docs[a][1]))]
    gone = set()
    for a, i in places:
        for b, j in places:
            if (b, j) >= (a, i):
                break
            n = 0
            while i + n < len(docs[a][1]) and j + n < len(docs[b][1]) and docs[a][1][i + n] == docs[b][1][j + n]:
                n += 1
            if n and sum(map(words, docs[a][1][i : i + n])) >= least:
                gone |= {(a, k) for k in range(i, i + n)}
    return {docs[a][0]: "\n".join(x for k, x in enumerate(docs[a][1]) if (a, k) not in gone) for a in range(len(docs))}


@pytest.mark.parametrize(("seed", "few"), [(1, 1 << 16), (2, 0)])
def test_equals_brute_force(spark, seed, few):
    rnd = random.Random(seed)
    lines = [" ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.choice([0, 1, 2, 5, 9, 30]))) for _ in range(12)]
    rows = [(d, "\n".join(rnd.choices(lines, weights=[9] * 3 + [1] * 9, k=rnd.choice([1, 2, 5, 12])))) for d in range(25)]
    rows.append((99, "\n".join(["a b"] * 40)))
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), min_words=20, broadcast_rows=few).collect()
    want = brute(rows, 20)
    assert {r.doc_id: r.text for r in got} == {d: want.get(d, t) for d, t in rows}
    assert all(r.n_lines - r.n_removed == (len(r.text.split("\n")) if r.text or r.n_removed < r.n_lines else 0) for r in got)


def test_odd_rows(spark):
    long = "word " * 60 + "end"
    rows = [(3, long, 1), (3, "other\n" + long, 2), (None, long, 3), (1, None, 4), (2, "", 5), (5, "\n\n", 6), (2**62, long + "\nown", 7), (3, long, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    got = dedup_lines(df, Scratch(spark, "t")).collect()
    assert len(got) == 8
    kept = [r for r in got if r.text and long in r.text]
    assert {r.doc_id for r in kept} == {3} and len({r.text for r in kept}) == 1
    assert {r.doc_id: r.text for r in got if r.doc_id in (1, 2, 5, 2**62)} == {1: None, 2: "", 5: "\n\n", 2**62: "own"}
    assert dedup_lines(df.limit(0), Scratch(spark, "t")).collect() == []


def test_rows_without_ids_are_told_apart(spark):
    """Many null ids: each row is a document of its own, whatever their texts' hashes."""
    long = "word " * 60 + "end"
    rows = [(1, long), *((None, f"own {i}\nline {i}") for i in range(300)), (None, "v v\n" + long), (-5, "minus\n" + long)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) == 2
    assert {r.doc_id: r.text for r in got if r.doc_id} == {1: "", -5: "minus\n" + long}
    assert sorted(r.text for r in got if r.doc_id is None) == sorted([*(f"own {i}\nline {i}" for i in range(300)), "v v"])
    two = spark.createDataFrame([(7, long), (7, "other"), (7, long), (9, "x\n" + long)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in dedup_lines(two, Scratch(spark, "t")).collect()) == sorted([(7, long), (7, "other"), (7, ""), (9, "x")])
