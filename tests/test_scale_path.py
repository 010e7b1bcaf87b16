"""The multi-pass quantile path (used when a group exceeds the per-task bound,
as a hot key would at scale) gives the oracle's answers on the real fixture."""

import pytest

from conftest import SF_SMALL
from test_oracle_small import _rows

import __spark_entry__ as E

QUANTILE_QUERIES = ["kpi_row", "bill_summary", "box_bill", "box_outliers", "wtp_median_by_segment",
                    "impute_median", "stratified_split", "prospect_quadrants"]


@pytest.fixture()
def tiny_bound(spark):
    spark.conf.set("spark.canvass.quantile.finishLimit", "25")
    spark.conf.set("spark.canvass.quantile.buckets", "16")
    yield
    spark.conf.unset("spark.canvass.quantile.finishLimit")
    spark.conf.unset("spark.canvass.quantile.buckets")


@pytest.mark.parametrize("name", QUANTILE_QUERIES)
def test_multi_pass_matches_oracle(spark, duck, tiny_bound, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dd = duck.execute(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dd)
