import numpy as np

from tests_llm_helpers import rows_of
from tickwatch.llm import nb_svm, queries
from tickwatch.llm.common import remainder

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    out = queries.QUERIES["op10_nb_svm"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").toPandas()
    assert len(rows) > 30
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert (good.predicted == 1).mean() > 0.98 and (bad.predicted == 0).mean() > 0.9
    assert ((rows.score >= 0) & (rows.score <= 1)).all()
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) quality")
    a, b = nb_svm.fit_quality(docs, labels), nb_svm.fit_quality(docs, flipped)
    assert np.allclose(a.weights, b.weights) and a.slope == b.slope


def test_dual_coordinate_descent_separates():
    x = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    w = nb_svm.descend(x, np.array([1.0, 1.0, -1.0, -1.0]), np.ones(4), cost=10.0, epochs=200)
    margins = [w[i].sum() for i in x]
    assert all(m >= 0.99 for m in margins[:2]) and all(m <= -0.99 for m in margins[2:])
    assert np.allclose(w, [1, -1, 0, 0], atol=1e-2)


def test_odd_rows_and_missing_labels(spark, documents, odd_rows):
    docs = documents(odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in rows_of(nb_svm.score_quality(docs, nb_svm.fit_quality(docs, none)))} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert {r["score"] for r in rows_of(nb_svm.score_quality(docs, nb_svm.fit_quality(docs, ones)))} == {1.0}
    mixed = spark.createDataFrame([(i, i % 2) for i in range(9)] * 2, "doc_id long, quality int")
    out = rows_of(nb_svm.score_quality(docs, nb_svm.fit_quality(docs, mixed)))
    assert len(out) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in out)
    empty = documents([])
    assert nb_svm.score_quality(empty, nb_svm.fit_quality(empty, mixed)).count() == 0
    assert docs.select(remainder("doc_id", 5).alias("r")).filter("r is null").count() == 0
