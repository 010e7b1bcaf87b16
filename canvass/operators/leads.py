"""Lead list and top-n.

Sorting plus ``limit`` plans as ``TakeOrderedAndProject``: every partition
keeps its own best ``n`` rows and only those meet in the final merge, so no
full sort or shuffle of the input happens. The rank column is numbered after
the cut, over at most ``n`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions.labels import money
from canvass.operators.select import member_predicate
from canvass.sources.schema import LEAD_VIEW_COLS


def top_n(df: DataFrame, order: Sequence[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows by ``order`` (include a unique key last for a stable cut), numbered 1..n."""
    cut = df.orderBy(*order).limit(n)
    return cut.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("long"))


def lead_table(df: DataFrame, classes: Sequence[str] = ("High-Intent Buyer",), n: int = 50,
               id_col: str = "respondent_id") -> DataFrame:
    """Prospects of the chosen adoption classes (``None`` chooses rows without one), best ``n`` by pilot interest
    then AI openness (both descending), ties by id; money columns labelled."""
    picked = df.where(member_predicate("adoption_class", classes)).select(*LEAD_VIEW_COLS)
    order = [F.col("pilot_interest").desc_nulls_last(), F.col("ai_openness").desc_nulls_last(),
             F.col(id_col).asc()]
    out = top_n(picked, order, n, "lead_rank")
    return out.withColumns({"wtp_label": money("wtp_aed_per_building"),
                            "bill_label": money("monthly_bill_aed")})


def ranked_values(df: DataFrame, name_col: str, value_col: str, n: int) -> DataFrame:
    """O3: the ``n`` largest values (ties by name), numbered, for importance charts."""
    order = [F.col(value_col).desc(), F.col(name_col).asc()]
    return top_n(df, order, n, "rank")
