import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from canvass.operators import profile, split
from canvass.sources import io


def test_missing_source_raises(spark):
    with pytest.raises(AnalysisException):
        io.read_responses(spark, "/nonexistent/survey.csv", fmt="csv").count()


def test_empty_input_gives_empty_results(responses_small):
    empty = responses_small.where(F.col("respondent_id") < 0)
    assert profile.kpi_row(empty, "segment").count() == 0
    assert profile.frequency(empty, "segment").count() == 0


def test_csv_roundtrip(spark, responses_small):
    path = io.write_csv(responses_small)
    back = io.read_responses(spark, path, fmt="csv")
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in io.RESPONSES_SCHEMA]
    assert back.exceptAll(responses_small).count() == 0 and back.count() == 1500


def test_splits_deterministic_and_stratified(responses_small):
    s1 = split.stratified_split(responses_small, "adoption_class").cache()
    shares = {r[0]: r[1] for r in s1.groupBy("adoption_class").agg(F.avg(F.col("is_test").cast("double"))).collect()}
    for v in shares.values():
        assert 0.24 <= v <= 0.27
    s2 = split.random_split(responses_small)
    a = [r[0] for r in s2.where("is_test").select("respondent_id").orderBy("respondent_id").collect()]
    b = [r[0] for r in split.random_split(responses_small.repartition(3)).where("is_test")
         .select("respondent_id").orderBy("respondent_id").collect()]
    assert a == b and 0.2 < len(a) / 1500 < 0.3


def test_stratified_folds_balance_each_class(responses_small):
    f = split.stratified_folds(responses_small, "adoption_class", folds=5).cache()
    counts = {(r[0], r[1]): r[2] for r in f.groupBy("adoption_class", "fold").count().collect()}
    for cls in ("Evaluator", "High-Intent Buyer", "Not Ready"):
        sizes = [counts.get((cls, i), 0) for i in range(5)]
        assert max(sizes) - min(sizes) <= 2, (cls, sizes)
