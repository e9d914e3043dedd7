import duckdb

import corpus_pipeline as pipeline
from formlens.llm.common import Scratch, table
from formlens.llm.mixing import mixing_sql
from tests.llm.test_jaccard_join import brute as near_brute
from tests.llm.test_line_dedup import brute as line_brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs, kept, texts = table(spark, SF, "documents"), Scratch(spark, "t"), {}
    columns = docs.columns
    texts["documents"] = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = kept.save(stage(spark, docs, SF), name.replace(" ", "-"))
        rows = docs.collect()
        texts[name] = {r.doc_id: r.text for r in rows}
        assert docs.columns == columns and all(r.n_chars == len(r.text) for r in rows) and len(texts[name]) == len(rows)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    bad, good = ({d for d, q in labels.items() if q == k} for k in (0, 1))
    assert good <= set(texts["quality"]) and len(bad & set(texts["quality"])) < len(bad) / 2
    want = line_brute(list(texts["quality"].items()), 50)
    assert texts["line dedup"] == {d: want.get(d, t) for d, t in texts["quality"].items() if want.get(d, t) or not t}
    groups = near_brute(list(texts["line dedup"].items()))
    assert texts["near duplicates"] == {d: t for d, t in texts["line dedup"].items() if groups[d][1] == d}
    con = duckdb.connect()
    documents = before.toArrow()  # noqa: F841
    sampled = {r[0] for r in con.sql(mixing_sql()).fetchall() if r[6]}
    assert texts["mixing"] == {d: t for d, t in texts["near duplicates"].items() if d in sampled}
    out = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == set(texts["mixing"]) and all(r.decoded for r in out)
    run = pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r["sample"], tuple(r.ids)) for r in run) == sorted((r.doc_id, r["sample"], tuple(r.ids)) for r in out)


def test_odd_rows(spark):
    """Null and repeated ids, null and empty texts, other columns, and an empty table through each stage."""
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    x, y = words("x", 80), words("y", 80)
    rows = [(1, x), (1, x), (5, y), (5, x), (None, x), (None, words("z", 30)), (2, x.replace("x7 ", "other ")), (6, None), (7, ""), (None, None), (8, " \n"), (9, words("w", 20_000)), (9, y)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_lines int")
    docs = Scratch(spark, "t").save(docs.withColumnsRenamed({"n_lines": "component_id"}), "docs")
    kept = pipeline.one_of_each(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, x), (5, y), (None, words("z", 30)), (6, None), (7, ""), (None, None), (8, " \n"), (9, words("w", 20_000))]))
    # Later copies of x (three) and y (one) lose their only line, and with it go.
    lines = pipeline.line_dedup(spark, docs, SF)
    assert lines.columns == docs.columns and lines.count() == 13 - 4
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        assert stage(spark, docs.limit(0), SF).collect() == []
