import numpy as np
import pytest
from pyspark.sql import functions as F

from formlens.llm.common import table
from formlens.llm.quality import dual_coordinate_descent, score_quality, train_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_no_leak(spark):
    from formlens.llm.queries import op1_quality_classifier

    got = op1_quality_classifier(spark, SF)
    both = got.join(table(spark, SF, "labels"), "doc_id").filter("held_out")
    right, n = both.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 50 and right >= 0.97
    assert got.count() == 1000 and got.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0


def test_odd_rows(spark):
    good, bad = "a calm line of words here", "x!! Y!! Z!! AA!!"
    docs = spark.createDataFrame([(i, good if i % 2 else bad, "s", 9.0) for i in range(60)] + [(None, None, "s", 1.0), (70, "", "s", 1.0), (71, good * 3000, "s", 2.0), (1, good, "s", 9.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = train_quality(docs, labels)
    rows = score_quality(docs, model).collect()
    assert len(rows) == 64 and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in rows if r.text == good} == {1} and {r.predicted for r in rows if r.text == bad} == {0}
    assert score_quality(docs.limit(0), model).collect() == []
    assert train_quality(docs, labels.limit(0)).bias == 0.0
    assert {r.score for r in score_quality(docs, train_quality(docs, labels.limit(0))).collect()} == {0.5}


def test_descent_separates():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(80, 4))
    y = np.where(x[:, 0] + 0.1 > 0, 1.0, -1.0)
    w = dual_coordinate_descent([(np.arange(5), np.r_[r, 1.0]) for r in x], y, np.full(80, 50.0), 5, epochs=400)
    assert ((x @ w[:4] + w[4]) * y > 0).mean() > 0.97


@pytest.mark.parametrize("text", ["", " ", "\n"])
def test_empty_texts_score_alike(spark, text):
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    model = train_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert len({r.score for r in score_quality(docs, model).collect()}) == 1
