from collections import defaultdict

import pytest

from formlens.llm.common import Scratch, table
from formlens.llm.mixing import marginal_gap, mix_sources, rake, tokens, topic

SF = "/root/testdata/sf0.01"


def test_marginals_are_met(spark):
    cells = spark.createDataFrame([(s, l, t, 10 + 7 * i) for i, (s, l, t) in enumerate((s, l, t) for s in "ab" for l in "xyz" for t in "pq")], "source string, lang string, topic string, t long")
    rows = rake(cells, {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.5}, "topic": 0.0}, Scratch(spark, "t"), rounds=40).collect()
    total, by = sum(r.t for r in rows), defaultdict(float)
    for r in rows:
        by["source", r.source] += r.w / total
        by["lang", r.lang] += r.w / total
        by["topic", r.topic] += r.w / total
    assert by["source", "a"] == pytest.approx(0.7, abs=1e-6) and by["lang", "x"] == pytest.approx(0.5, abs=1e-6) and by["topic", "p"] == pytest.approx(0.5, abs=1e-6)
    y, z = (sum(r.t for r in rows if r.lang == k) for k in "yz")
    assert by["lang", "y"] / by["lang", "z"] == pytest.approx(y / z, rel=1e-6)


def test_convergence_is_checked(spark):
    cells = spark.createDataFrame([(s, l, t, 10 + 7 * i) for i, (s, l, t) in enumerate((s, l, t) for s in "ab" for l in "xy" for t in "pq")], "source string, lang string, topic string, t long")
    targets = {"source": {"a": 0.1, "b": 0.9}, "lang": {"x": 0.2, "y": 0.8}, "topic": {"p": 0.5, "q": 0.5}}
    close = rake(cells, targets, Scratch(spark, "t"), rounds=5, tolerance=1e-9)
    assert marginal_gap(close) <= 1e-9 < marginal_gap(rake(cells, targets, Scratch(spark, "t"), rounds=1))
    pair = cells.filter("(source = 'a') = (lang = 'x')")
    with pytest.raises(ValueError):
        rake(pair, targets, Scratch(spark, "t"), rounds=2, tolerance=1e-9, turns=2)


def test_the_corpus_is_mixed_to_its_targets(spark):
    """Ten rounds bring the corpus' own marginals to their targets."""
    docs = table(spark, SF, "documents").selectExpr("source", "lang", "text")
    cells = docs.select("source", "lang", topic(docs.text).alias("topic"), tokens(docs.text).alias("t")).groupBy("source", "lang", "topic").sum("t").withColumnRenamed("sum(t)", "t").filter("t > 0")
    assert marginal_gap(rake(cells, {"source": 0.5, "lang": 0.7, "topic": 0.7}, Scratch(spark, "t"))) < 1e-4


def test_expected_tokens_meet_the_budget(spark):
    rows = mix_sources(table(spark, SF, "documents"), Scratch(spark, "t"), budget=0.4).collect()
    total = sum(r.tokens for r in rows)
    assert sum(r.tokens * r.p for r in rows) == pytest.approx(0.4 * total, rel=1e-6)
    assert abs(sum(r.tokens for r in rows if r.sampled) / total - 0.4) < 0.06 and len(rows) == 1000


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b", None, None, 1), (None, "c d e", "s", "en", 2), (2, None, "s", "en", 3), (3, "", "z", "zz", 4), (1, "a b", None, None, 5), (4, "x " * 9000, "s", "en", 6)], "doc_id long, text string, source string, lang string, p int")
    rows = mix_sources(df, Scratch(spark, "t"), budget=1.0).collect()
    assert len(rows) == 6 and all(r.p == pytest.approx(1.0) for r in rows if r.tokens) and [r.p for r in rows if r.doc_id == 3] == [0.0]
    assert len({r.sampled for r in rows if r.doc_id == 1}) == 1
    assert mix_sources(df.limit(0), Scratch(spark, "t")).collect() == []
    with pytest.raises(ValueError):
        mix_sources(df, Scratch(spark, "t"), {"lang": {"en": 1.5}})
