"""Models are trained on partitions of bounded size, whatever the partitions of the table."""

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from sparkloom.operators import ml as M
from sparkloom.operators import profile as P


@pytest.fixture()
def seen(monkeypatch):
    """Rows of the largest partition of every fit."""
    rows, fit = [], GBTRegressor._fit

    def counted(self, dataset):
        rows.append(dataset.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return fit(self, dataset)

    monkeypatch.setattr(GBTRegressor, "_fit", counted)
    monkeypatch.setattr(M, "ROWS", 200)
    return rows


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(0, 1000, 1, 1).select((F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), (F.col("id") % 37 * 2 + F.col("id") % 11).cast("double").alias("y"))


def test_train(one, seen):
    m = M.train(one, "m", ["a", "b"], "y", "REGRESSION", iterations=3)
    assert len(seen) == 1 and seen[0] <= 200
    assert [type(s).__name__ for s in m.pipeline.stages] == ["ImputerModel", "VectorAssembler", "GBTRegressionModel"]
    assert M.predict(m, one).count() == 1000


def test_importance_of_a_trained_model(spark, one, seen):
    rows = M.importance(M.train(one, "m", ["a", "b"], "y", "REGRESSION", iterations=3), spark).collect()
    assert max(seen) <= 200 and rows[0].feature == "a" and sum(r.importance for r in rows) == pytest.approx(1)


def test_search(one, seen):
    assert M.search(one, ["a", "b"], "y", {"maxDepth": [2], "maxIter": [2]}, folds=2).count() == 1
    assert len(seen) == 3 and max(seen) <= 200


def test_analysis(one, seen):
    rows = P.importance(one, "y", ["a", "b"]).collect()
    assert len(seen) == 1 and seen[0] <= 200 and [r.column for r in rows] == ["a", "b"]


def test_small_tables_stay_as_they_are(one):
    assert M.spread(one, M.ROWS) is one


def test_query_on_lines_of_one_file(spark, seen):
    import sparkloom.queries as Q

    Q.load()
    rows = Q.QUERIES["ml_importance"](spark, "/root/testdata/sf0.001").collect()
    assert len(seen) == 1 and seen[0] <= 200
    assert {r.feature for r in rows} == {"l_quantity", "l_discount", "l_tax"}


def test_importances_stay_where_no_split_is_sampled(one, monkeypatch):
    weights = lambda: M.train(one, "m", ["a", "b"], "y", "REGRESSION", iterations=3).pipeline.stages[-1].featureImportances.toArray()
    whole = weights()
    monkeypatch.setattr(M, "ROWS", 200)
    assert weights() == pytest.approx(whole, abs=1e-9)
