import pytest
from pyspark.sql import functions as F

from graphloom.operators import scoring as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scores(spark):
    assert value(spark, S.node_weight(F.lit(0.5), F.lit(0.0))) == 0.8
    assert value(spark, S.final_score(F.lit(0.4), F.lit(2), F.lit(0.5))) == pytest.approx(0.5 * 0.4 + 0.5 * 0.5)
    assert value(spark, S.semantic_score(F.lit(0.1), F.lit(0.1), F.lit(0.5), F.lit(0.3))) == 0.0


def test_procedures(spark, rows):
    points = spark.createDataFrame([("p", "k"), ("q", "l")], "procedure string, point string")
    status = spark.createDataFrame([("p", "active"), ("q", "deprecated")], "procedure string, status string")
    hits = spark.createDataFrame([("k", 0.1), ("q", 0.2), ("l", 0.4)], "id string, score double")
    assert rows(S.procedure_bundles(points, hits, status)) == [("p", 1.1), ("q", 0.9)]


def test_buckets(spark, rows):
    schema = "expected boolean, triggered boolean, n_hits int, hit_rank int, injected boolean, active boolean"
    cases = spark.createDataFrame([(True, False, 0, None, False, False), (False, True, 1, None, False, False), (True, True, 3, 2, False, True)], schema)
    assert rows(S.failure_buckets(cases)) == [("false trigger", 1), ("low rank", 1), ("missed trigger", 1), ("no hits", 1), ("not injected", 1)]
