"""Every registered query with an oracle, against DuckDB at sf0.001 (fast subset of the driver gate)."""

import math

import pandas as pd
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E

# left to the driver's gate: a large result, and fits that tests/test_models.py and tests/test_trees.py also make
SLOW = {"csv_roundtrip", "kmeans_facts", "gbt_test_rows", "importance_facts", "gbt_scored_by_table", "importances_by_table",
        "residual_boost_facts"}
KEYS = [k for k in E.oracle_sql() if k not in SLOW]


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        row = []
        for v in rec:
            if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                row.append(None)
            elif isinstance(v, float):
                row.append(round(v, 6))
            else:
                row.append(v.item() if hasattr(v, "item") else v)
        out.append(tuple(row))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dd = duck.execute(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dd)
