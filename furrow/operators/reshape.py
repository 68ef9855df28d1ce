"""Wide to long, long to wide, rows to months."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import fixed_values as fixed
from furrow.functions.scalars import number_or_zero, year_number


def melt_years(df: DataFrame, ids: Sequence[str], years: Sequence[str], value: str = "value") -> DataFrame:
    """One row per id and year; text numbers repaired, years as integers."""
    long = df.unpivot(list(ids), list(years), "year", value)
    return long.withColumns({value: number_or_zero(F.col(value)), "year": year_number(F.col("year"))})


def pivot_kinds(df: DataFrame, keys: Sequence[str] = ("crop", "location", "season", "year")) -> DataFrame:
    """Area and production side by side; a kind without rows stays null."""
    wide = df.groupBy(*keys).pivot("kind", ["area", "production"]).agg(F.sum("value"))
    return wide.withColumnsRenamed({"area": "area_size", "production": "total_yield"})


def pivot_first(df: DataFrame, keys: Sequence[str], names: str, value: str, order: str, wanted: Mapping[str, str]) -> DataFrame:
    """First present value per key and name, in the order of ``order``."""
    present = df.where(F.col(value).isNotNull())
    wide = present.groupBy(*keys).pivot(names, list(wanted)).agg(F.min_by(value, order))
    return wide.withColumnsRenamed(dict(wanted))


def to_months(df: DataFrame, total: str = "total_yield") -> DataFrame:
    """Twelve rows per row, the yearly total spread evenly."""
    months = F.array(*[F.lit(m) for m in fixed.MONTHS])
    return df.withColumns({"month": F.explode(months), "monthly_yield_est": F.col(total) / len(fixed.MONTHS)})


def to_season_months(df: DataFrame, season: str = "season", total: str = "total_yield") -> DataFrame:
    """Six rows per row of a known season; an unknown season keeps one row, no month."""
    months = None
    for name, members in fixed.HALF_YEAR_MONTHS.items():
        listed = F.array(*[F.lit(m) for m in members])
        months = F.when(F.col(season) == name, listed) if months is None else months.when(F.col(season) == name, listed)
    return df.select(*df.columns, F.explode_outer(months).alias("month"), (F.col(total) / 6).alias("monthly_yield_est"))
