from collections import Counter

import numpy as np

from formlens.llm.queries import PIECES
from formlens.llm.subword import decode_samples, encode_samples, sample_segmentations, vocabulary


def segmentations(word, v):
    """All segmentations of a word with their weights, by plain recursion."""
    pieces = {}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            pieces[sp.id_to_piece(i)] = i

    def rest(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in pieces:
                for ids, w in rest(s[n:]):
                    yield (pieces[s[:n]], *ids), w + v.weight[pieces[s[:n]]]

    found = dict(rest("▁" + word))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: w - total for k, w in found.items()}


def test_distribution_and_inclusion_match_enumeration():
    v, n = vocabulary(PIECES), 6000
    truth = segmentations("the", v)
    first, weighted = Counter(), Counter()
    per: dict[int, list] = {}
    for d, s, ids, lp, g, inclusion in sample_segmentations(["the"] * n, np.arange(n, dtype=np.uint64), v, 2):
        per.setdefault(d, []).append((tuple(ids), g))
        assert abs(lp - truth[tuple(ids)]) < 1e-9 and 0 <= inclusion <= 1
        first[tuple(ids)] += s == 1
        weighted[tuple(ids)] += 1 / inclusion
    for ids, lp in truth.items():
        p = np.exp(lp)
        assert abs(first[ids] / n - p) < 4 * np.sqrt(p * (1 - p) / n) + 2e-3
        if p > 0.02:
            assert abs(weighted[ids] / n - 1) < 0.1
    assert all(len({x for x, _ in r}) == len(r) and [g for _, g in r] == sorted((g for _, g in r), reverse=True) for r in per.values())


def test_exhausts_small_lattices():
    v = vocabulary(PIECES)
    truth = segmentations("an", v)
    rows = list(sample_segmentations(["an"], np.array([5], np.uint64), v, len(truth) + 3))
    assert {tuple(r[2]) for r in rows} == set(truth) and len(rows) == len(truth) and all(r[5] == 1.0 for r in rows)


def test_pieces_of_several_word_marks_are_sampled():
    v = vocabulary(PIECES)
    truth = segmentations("▁▁a", v)
    rows = list(sample_segmentations(["  a"], np.array([5], np.uint64), v, len(truth) + 3))
    assert {tuple(r[2]) for r in rows} == set(truth) and any(len(t) < 4 and v.raw_start[t[0] + 1] - v.raw_start[t[0]] > 1 for t in truth)
    assert all(abs(r[3] - truth[tuple(r[2])]) < 1e-9 for r in rows)


def test_words_of_a_regular_structure_decode(spark):
    """Thue-Morse words, which collide in every polynomial hash over a power of two."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    assert all(r.decoded for r in encode_samples(spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string"), PIECES).collect())


def test_round_trip_and_odd_rows(spark):
    texts = ["plain words here", " lead and  double ", "ünï🙂\tçode\nline ▁ mark", "", None, "x" * 3000, "\n\n", "日本語テスト", "word " * 5000]
    docs = spark.createDataFrame([(i, t, [1], 0.5) for i, t in enumerate(texts)] + [(None, "null key", [2], 0.1), (0, texts[0], [3], 0.2)], "doc_id long, text string, ids array<int>, log_prob double")
    got = encode_samples(docs, PIECES, k=3)
    rows = got.collect()
    assert all(r.decoded for r in rows) and len({(r.doc_id, r["sample"], tuple(r.ids)) for r in rows if r.doc_id == 0}) == 3
    assert [(r.n_pieces, r.inclusion) for r in rows if r.doc_id == 3] == [(0, 1.0)]
    back = {(r.doc_id, r["sample"]): r.text for r in decode_samples(got, PIECES).collect()}
    assert all(back[i, 1] == (t or "") for i, t in enumerate(texts)) and back[None, 1] == "null key"
    again = {(r.doc_id, r["sample"]): tuple(r.ids) for r in encode_samples(docs.repartition(5), PIECES, k=3, chunk_bytes=64).collect()}
    assert again == {(r.doc_id, r["sample"]): tuple(r.ids) for r in rows}
    assert encode_samples(docs.limit(0), PIECES).collect() == []
