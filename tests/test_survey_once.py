"""Model queries join the survey once; repeated values are counted before ranks are looked for."""

import pytest
from pyspark.sql import functions as F

from canvass.operators import quantile


def test_repeated_values_are_counted(spark, monkeypatch):
    """More values than the limit but few distinct ones: no selection passes, nothing written."""
    df = spark.range(5000).select((F.col("id") % 4).cast("double").alias("x"))
    monkeypatch.setattr(quantile, "stored", lambda *a: pytest.fail("values were written"))
    assert quantile.quantiles(df, ["x"], [0.5, 1.0], finish_limit=100).toPandas()["value"].tolist() == [1.5, 3.0]


def test_model_queries_join_the_survey_once(spark, monkeypatch):
    from canvass.plans import catalog
    made = []
    whole = catalog.responses
    monkeypatch.setattr(catalog, "responses", lambda *a: made.append(a) or whole(*a))
    monkeypatch.setattr(catalog, "_FITS", {})
    monkeypatch.setattr(catalog.reuse, "find", lambda *a: None)
    survey = catalog._survey(spark, "/root/testdata/sf0.001")
    assert catalog._survey(spark, "/root/testdata/sf0.001") is survey and len(made) == 1
    assert survey.count() > 0 and not any("lineitem" in f for f in survey.inputFiles())
