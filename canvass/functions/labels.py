"""Scalar column functions: labels, recodes, rounding and lookups.

All are built-in Spark expressions (JVM side, inside whole-stage codegen).
Number formatting uses ``format_number`` (Java DecimalFormat, half-even on the
binary value), which agrees with Python's ``format`` for ``,.Nf`` / ``.Nf``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The item-name recode of basket columns (prefix -> label prefix).
ITEM_PREFIXES = [("pain_", "PAIN:"), ("monitor_", "MON:"), ("tech_", "TECH:")]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def grouped(x, decimals: int = 0) -> Column:
    """``f"{x:,.{d}f}"``: thousands separators, half-even rounding."""
    return F.format_number(_c(x), decimals)


def fixed(x, decimals: int = 0) -> Column:
    """``f"{x:.{d}f}"`` (no separators)."""
    return F.regexp_replace(F.format_number(_c(x), decimals), ",", "")


def money(x) -> Column:
    """``AED 1,234`` money label."""
    return F.concat(F.lit("AED "), grouped(x, 0))


def percent_label(x, decimals: int = 1) -> Column:
    """``12.3%`` for a value already in percent."""
    return F.concat(fixed(x, decimals), F.lit("%"))


def thousands_label(x) -> Column:
    """``AED 194k`` (value divided by 1,000, no decimals)."""
    return F.concat(F.lit("AED "), fixed(_c(x) / 1000, 0), F.lit("k"))


def millions_label(x, decimals: int = 1) -> Column:
    """``AED 54.3M`` (value divided by 1e6)."""
    return F.concat(F.lit("AED "), fixed(_c(x) / 1e6, decimals), F.lit("M"))


def title_label(x, prefix: str = "") -> Column:
    """Strip ``prefix``, ``_`` to space, title case: 'pain_high_cost' -> 'High Cost'."""
    c = _c(x)
    if prefix:
        c = F.replace(c, F.lit(prefix), F.lit(""))
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def title_text(name: str, prefix: str = "") -> str:
    """Python twin of :func:`title_label` for column names (metadata only)."""
    return name.replace(prefix, "").replace("_", " ").title() if prefix else \
        name.replace("_", " ").title()


def item_name(name: str) -> str:
    """Basket item label of a flag column: 'pain_high_cost' -> 'PAIN:HIGH_COST'."""
    for old, new in ITEM_PREFIXES:
        name = name.replace(old, new)
    return name.upper()


def item_label(x) -> Column:
    """Spark expression form of :func:`item_name` for a column of names."""
    c = _c(x)
    for old, new in ITEM_PREFIXES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.upper(c)


def single_line(x) -> Column:
    """newlines to spaces (multi-line display names on one line)."""
    return F.replace(_c(x), F.lit("\n"), F.lit(" "))


def round_half_even(x, decimals: int = 3) -> Column:
    """pandas ``.round(d)``: half-even."""
    return F.bround(_c(x), decimals)


def truncate_to_long(x) -> Column:
    """Python ``int(x)``: truncates toward zero."""
    return _c(x).cast("long")


def lookup(x, mapping: Mapping, default=None) -> Column:
    """Value of ``x`` looked up in a fixed code map."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    found = F.element_at(F.create_map(*pairs), _c(x)) if pairs else F.lit(None)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def prefix(x, n: int) -> Column:
    """First ``n`` characters (``s[:n]``)."""
    return F.substring(_c(x), 1, n)
