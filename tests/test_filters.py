from pyspark.sql import functions as F

from canvass.operators import select


def _df(spark):
    return spark.createDataFrame(
        [(1, "a", "x"), (2, "b", "y"), (3, None, "x"), (4, "a", None)], "id int, seg string, em string")


def test_membership_keeps_selected_null(spark):
    df = _df(spark)
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(select.filter_members(df, {"seg": ["a"]})) == [1, 4]
    assert ids(select.filter_members(df, {"seg": ["a", None]})) == [1, 3, 4]
    assert ids(select.filter_members(df, {"seg": ["a", None], "em": ["x"]})) == [1, 3]
    assert ids(select.filter_members(df, {"seg": []})) == []


def test_optional_filter_empty_means_all(spark):
    df = _df(spark)
    assert select.optional_filter(df, "seg", []).count() == 4
    assert select.optional_filter(df, "seg", ["b"]).count() == 1


def test_counts_and_empty_guard(spark):
    df = _df(spark)
    row = select.filtered_counts(df, {"seg": ["a"]}).first()
    assert (row["n_shown"], row["n_total"]) == (2, 4)
    assert select.is_empty(df.where(F.col("id") > 10))
    opts = select.distinct_values(df, "seg").collect()
    assert [r[0] for r in opts] == ["a", "b", None]
