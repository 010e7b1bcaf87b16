"""With the broadcast bound at 0 rows every size-checked join takes its
shuffle-join fallback; results must not change."""

import pytest

from conftest import SF_SMALL
from test_oracle_small import _rows

import __spark_entry__ as E

JOINING = ["box_outliers", "hist_wtp_by_class", "rules_all", "stratified_split", "inertia_given_labels",
           "bill_summary"]


@pytest.fixture()
def no_broadcast(spark):
    # cached relations from earlier tests keep the physical plans they were
    # built with; start clean so every join is planned under the new bound
    spark.catalog.clearCache()
    spark.conf.set("spark.canvass.broadcast.maxRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.catalog.clearCache()
    spark.conf.unset("spark.canvass.broadcast.maxRows")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", JOINING)
def test_fallback_matches_oracle(spark, duck, no_broadcast, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert _rows(df.toPandas()) == _rows(duck.execute(E.oracle_sql()[name]).df())
