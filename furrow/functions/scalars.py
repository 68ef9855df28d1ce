"""Column functions: text repair, ordinals, balances, fallbacks, formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import fixed_values as fixed


NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))$"


def normal_text(column: Column) -> Column:
    """Lower-case text without white space at its ends; a missing value becomes the word 'nan'."""
    return F.lower(stripped(F.coalesce(column, F.lit("nan"))))


def stripped(column: Column) -> Column:
    """Without any white space at both ends, blanks or not."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def canonical_kind(column: Column) -> Column:
    """Any label that mentions area or production becomes that word."""
    return F.when(column.contains("area"), "area").when(column.contains("production"), "production").otherwise(column)


def number_or_zero(column: Column) -> Column:
    """Number from text with thousands separators; anything else is 0.

    The text must look like a number: a cast alone also takes type suffixes such as ``12d``.
    """
    text = stripped(F.regexp_replace(column.cast("string"), ",", ""))
    return F.coalesce(F.when(text.rlike(NUMBER), text.try_cast("double")), F.lit(0.0))


def year_number(column: Column) -> Column:
    return column.cast("int")


def zero_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(0.0))


def in_set(column: Column, allowed: Sequence) -> Column:
    """Membership that is false, not null, for a missing value."""
    return F.coalesce(column.isin(list(allowed)), F.lit(False))


def weighted(column: Column, weights: Mapping[str, float], other: float = 1.0) -> Column:
    """Weight of a category, ``other`` for the rest."""
    result = None
    for name, weight in weights.items():
        result = F.when(column == name, weight) if result is None else result.when(column == name, weight)
    return result.otherwise(F.lit(other))


def clipped(column: Column, low: float, high: float) -> Column:
    """Bounded value; unlike least/greatest a missing value stays missing."""
    return F.when(column < low, F.lit(low)).when(column > high, F.lit(high)).otherwise(column)


def at_least(column: Column, low: float) -> Column:
    return F.when(column < low, F.lit(low)).otherwise(column)


def date_parts(df: DataFrame, *columns: str) -> DataFrame:
    """{prefix}_year, _month, _day per date column; unreadable dates give null parts."""
    parts = {}
    for name in columns:
        prefix = name.split("_")[0]
        day = F.try_to_date(F.col(name).cast("string"))
        parts |= {f"{prefix}_year": F.year(day), f"{prefix}_month": F.month(day), f"{prefix}_day": F.dayofmonth(day)}
    return df.withColumns(parts)


def level_ordinal(column: Column) -> Column:
    """Low, Medium, High -> 0, 1, 2; anything else is null."""
    return F.when(column == "Low", 0).when(column == "Medium", 1).when(column == "High", 2)


def level_from_score(score: Column, cuts: tuple[float, float]) -> Column:
    low, high = cuts
    return F.when(score < low, "Low").when(score >= high, "High").otherwise("Medium")


def demand_pressure(supply: Column, demand: Column) -> Column:
    """0 when supply is ample or nothing is demanded, 2 when it is short, else 1."""
    low, high = fixed.BALANCE_CUTS
    ratio = F.try_divide(supply, demand)
    return F.when(demand == 0, 0).when(ratio > high, 0).when(ratio < low, 2).otherwise(1)


def sufficiency_by_balance(supply: Column, demand: Column) -> Column:
    """Surplus, Deficit or Balanced from tonnes."""
    low, high = fixed.BALANCE_CUTS
    return (
        F.when(demand == 0, "Balanced")
        .when(supply > demand * high, "Surplus")
        .when(supply < demand * low, "Deficit")
        .otherwise("Balanced")
    )


def supply_demand_ratio(supply_score: Column, demand_score: Column) -> Column:
    adjusted = clipped(supply_score * 0.92 + demand_score * 0.08, 0.0, 1.0)
    return F.bround(F.try_divide(adjusted, at_least(demand_score, 1e-4)), 6)


def sufficiency_by_score(supply_score: Column, demand_score: Column) -> Column:
    """Shortage, Balanced or Surplus from normalised scores."""
    low, high = fixed.RATIO_CUTS
    ratio = supply_demand_ratio(supply_score, demand_score)
    return F.when(ratio < low, "Shortage").when(ratio > high, "Surplus").otherwise("Balanced")


def sale_gap(sale: Column, as_of: Column) -> Column:
    """Days from ``as_of`` to the sale, never negative."""
    days = F.datediff(sale, as_of)
    return F.when(days < 0, 0).otherwise(days)


def hectares(donums: Column) -> Column:
    return donums * F.lit(fixed.HECTARES_PER_DONUM)


def fallback(value: Column, *others: Column) -> Column:
    """First of the values, where 0 counts as missing for the leading one."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), *others)


def per_hectare(rate: Column, area: Column) -> Column:
    return F.coalesce(rate, F.lit(0.0)) * area


def split_list(column: Column) -> Column:
    """Comma-separated text -> array of trimmed parts."""
    return F.transform(F.split(column, ","), lambda part: F.trim(part))


def never_negative(column: Column) -> Column:
    return F.when(column < 0, 0.0).otherwise(column)


def money_text(column: Column) -> Column:
    return F.concat(F.lit("$"), F.bround(column, 2).cast("string"))


def yield_text(column: Column) -> Column:
    return F.concat(F.bround(column, 2).cast("string"), F.lit(" Tons/Units"))


def label_text(index: Column, labels: Sequence[str]) -> Column:
    """Text of a label index, from the labels a fitted indexer learned."""
    pairs = [v for i, label in enumerate(labels) for v in (F.lit(float(i)), F.lit(label))]
    return F.create_map(*pairs)[index]


def pct_true(mask: Column) -> Column:
    """Share of rows (in %) where the mask holds; a null mask counts as false."""
    return F.round(F.avg(F.coalesce(mask, F.lit(False)).cast("double")) * 100, 4)
