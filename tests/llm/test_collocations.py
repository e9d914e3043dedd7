import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from formlens.llm import collocations as col
from formlens.llm.collocations import collocations
from formlens.llm.common import Scratch

DDL = "doc_id long, text string, lang string"


def brute(rows, top, least, longest=5):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang, text = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inner = {(lang, p[i : i + m]) for (lang, p), a in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if often[lang, p[i : i + m]] == a}
    out = []
    for lang in n:
        found = []
        for (own, p), a in often.items():
            if own == lang and (own, p) not in inner:
                score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run(spark, rows, **options):
    out = collocations(spark.createDataFrame(rows, DDL), Scratch(spark, "phrases"), **options)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("seed", "top", "band"), [(1, 10_000, 4096), (2, 12, 2)])
def test_against_brute_force(spark, seed, top, band):
    """The second case settles with bands of two first words, so most of the frontier is never expanded."""
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    fixed = ["New York City Hall opens today", "the quick brown fox", "ßä ö-x é"]
    rows = []
    for i in range(150):
        words = draw.choices(vocab, weights=[1 / (j + 1) for j in range(40)], k=draw.randrange(0, 120))
        for _ in range(draw.randrange(3)):
            words.insert(draw.randrange(len(words) + 1), draw.choice(fixed))
        rows.append((i, "".join(w + draw.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n"]) for w in words), draw.choice(["en", "en", "de", None])))
    want = brute(rows, top, 5)
    assert len(want) > 30 and run(spark, rows, top=top, least=5, band=band) == want


def test_bound_stops_the_search(spark):
    """Rare first words settle the report, frequent ones are then never expanded."""
    rows = [(i, "rare bird " + "and so on " * 50, "en") for i in range(20)]
    scratch = Scratch(spark, "bound")
    out = collocations(spark.createDataFrame(rows, DDL), scratch, top=1, least=5, band=1)
    assert [r["phrase"] for r in out.collect()] == [r[2] for r in brute(rows, 1, 5)]
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch.path)
    names = {x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
    assert "grown-1-2" in names and "band-3" in names and "grown-3-2" not in names


def test_overlaps_ties_and_repeats(spark):
    rows = [(1, "a a a a a a a", "x")] * 3 + [(2, "b c. b c! c b", "x")] * 3
    for top in (1, 2, 50):
        assert run(spark, rows, top=top, least=3) == brute(rows, top, 3)


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "", "en"), (1, " \t\n..", "en"), (2, "tie tie " * 30_000, None), (3, "tie tie", "und")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DDL + ", hash int")
    out = collocations(docs, Scratch(spark, "odd"), least=2)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 2000, 2)
    assert out.schema.simpleString() == "struct<lang:string,rank:int,phrase:string,a:bigint,l:bigint,r:bigint,n:bigint,score:bigint>"
    empty = collocations(docs.limit(0), Scratch(spark, "empty"))
    assert empty.count() == 0 and empty.schema.names == out.schema.names


def test_lean_chunks_are_taken_one_at_a_time():
    """Many chunks in one batch: the memory beyond the batch is that of one of them, whatever the words kept are sorted by."""
    draw, size, words = np.random.default_rng(5), 40_000, 30_000
    code, starts = draw.integers(0, words, size), draw.random(size) < 0.2
    place = draw.permutation(words)[:20_000].astype(np.int32)
    left, wide, codes, first = col.lean_chunk(place, place.astype(np.int64) * 10, code, starts)
    kept, piece = np.isin(code, place), np.cumsum(starts | np.r_[False, ~np.isin(code, place)[:-1]])
    new, begins = col._unpack(wide, codes, first)
    assert (left == np.sort(place) * 10).all() and (left[new] == code[kept] * 10).all() and (begins == np.r_[True, np.diff(piece[kept]) > 0]).all()
    pairs = pa.StructArray.from_arrays([pa.array(np.tile(place, 40)), pa.array(np.tile(place.astype(np.int64), 40))], names=["place", "hash"])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(41, dtype=np.int32) * len(place)), pairs)
    batch = pa.record_batch([lists, *(pa.array([x] * 40) for x in col._pack(code, starts, words))], names=["kept", "wide", "codes", "starts"])
    tracemalloc.start()
    n = sum(b.num_rows for b in col._lean(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40 and peak < 8 << 20


def test_frequent_words_are_numbered(spark):
    """Words of phrases go by small numbers instead of hashes, and no table of chunks' words is made to be shuffled."""
    rows = [(i, f"pair of words {i} " * 20, lang) for i in range(30) for lang in ("en", "de")]
    scratch = Scratch(spark, "numbers")
    corpus = col.Corpus(spark.createDataFrame(rows, DDL), scratch, 20)
    words = corpus.words.collect()
    assert {r.hash for r in words} == set(range(len(words))) and len(words) == 66
    vocab = [w for r in corpus.chunks.collect() for w in np.frombuffer(r.vocab, np.int64)]
    assert set(vocab) == set(range(len(words)))


def test_kept_words_by_parts():
    """Parts in any order, negative hashes, chunks without a kept word and parts without a word of the chunk."""
    draw = np.random.default_rng(3)
    hashes = draw.integers(-(2**63), 2**63 - 1, 500)
    chunks = [np.sort(draw.permutation(hashes)[:n].view(np.uint64)).view(np.int64) for n in (300, 1, 40)] + [np.array([5])]
    keep = draw.permutation(hashes)[:200]
    parts = [(keep[i : i + 70], np.arange(i, min(i + 70, 200))) for i in (140, 0, 70)]
    batch = pa.record_batch([pa.array([list(c) for c in chunks], pa.list_(pa.int64())), pa.array([False] * 4), pa.array([b""] * 4), pa.array([b""] * 4)], names=["hashes", "wide", "codes", "starts"])
    got = col.kept_words(batch, iter(parts)).column(0).to_pylist()
    number = {int(h): i for i, h in enumerate(keep)}
    assert [sorted((p["place"], p["hash"]) for p in kept) for kept in got] == [[(i, number[int(h)]) for i, h in enumerate(c) if int(h) in number] for c in chunks]
    assert [len(k) for k in col.kept_words(batch, iter(())).column(0).to_pylist()] == [0] * 4


def test_phrases_are_stored_slice_by_slice(spark, monkeypatch):
    """Phrases of several slices meet their counts one slice at a time, so no plan holds the broadcasts of all; none is lost."""
    class Seen(Scratch):
        plans = []

        def save(self, df, table, **options):
            self.plans.append((table, df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")))
            return super().save(df, table, **options)

        def append(self, df, table):
            self.plans.append((table, df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")))
            return super().append(df, table)

    monkeypatch.setattr(col, "SLICE", 3)
    corpus = col.Corpus(spark.createDataFrame([(i, "a b c d e f g h. ", "en") for i in range(20)], DDL), Seen(spark, "slices"), 20)
    grown = col._grow(corpus, corpus.words.select("lang", "hash", "f"), 3, "t")
    assert sorted(len(r.words) for r in grown.collect()) == [2] * 7 + [3] * 6
    held = [n for table, n in Seen.plans if table.startswith("grown")]
    assert len(held) > 2 and max(held) == 1


def test_stored_chunks_lie_in_small_files(spark, monkeypatch):
    """A file holds few chunks, as its row group is read at once, however many chunks one task makes."""
    monkeypatch.setattr(col, "CHUNK", 1 << 8)
    rows = spark.createDataFrame([(i, "many words of one text " * 8, "en") for i in range(40)], DDL).coalesce(1)
    files = col.Corpus(rows, Scratch(spark, "files"), 2).chunks.selectExpr("input_file_name() as f").groupBy("f").count().collect()
    assert sum(r["count"] for r in files) == 40 and max(r["count"] for r in files) <= 8
