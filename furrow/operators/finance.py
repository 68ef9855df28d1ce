"""Revenue, cost, profit, margin and efficiency; DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.checks import require_columns


def with_revenue(df: DataFrame) -> DataFrame:
    """Reported sales win over quantity times price."""
    require_columns(df, ["quantity_sold", "unit_price"])
    computed = F.col("quantity_sold") * F.col("unit_price")
    revenue = F.coalesce(F.col("total_sales"), computed) if "total_sales" in df.columns else computed
    return df.withColumns({"computed_revenue": computed, "revenue": revenue})


def with_cost(df: DataFrame, include_transport: bool = True) -> DataFrame:
    require_columns(df, ["total_expenses"])
    cost = F.col("total_expenses")
    if include_transport and "transport_cost" in df.columns:
        cost = cost + F.col("transport_cost")
    return df.withColumn("cost", cost)


def with_profit(df: DataFrame) -> DataFrame:
    require_columns(df, ["revenue", "cost"])
    profit = F.col("revenue") - F.col("cost")
    out = {"profit_calc": profit}
    if "profit" in df.columns:
        out["profit_diff"] = F.col("profit") - profit
    return df.withColumns(out)


def with_margin(df: DataFrame) -> DataFrame:
    require_columns(df, ["profit_calc", "revenue"])
    return df.withColumn("profit_margin_pct", F.try_divide("profit_calc", "revenue") * 100)


def with_efficiency(df: DataFrame) -> DataFrame:
    out = {}
    for used, name in (("water_used", "water_efficiency"), ("fertilizer_used", "fertilizer_efficiency")):
        if used in df.columns:
            require_columns(df, ["actual_yield"])
            out[name] = F.try_divide("actual_yield", used)
    return df.withColumns(out) if out else df


def finance_metrics(df: DataFrame, include_transport: bool = True) -> DataFrame:
    """All finance columns, in dependency order; one projection after optimisation."""
    return (
        df.transform(with_revenue)
        .transform(with_cost, include_transport)
        .transform(with_profit)
        .transform(with_margin)
        .transform(with_efficiency)
    )


def summary_by_crop(df: DataFrame, key: str = "crop_name") -> DataFrame:
    """Sums per crop and the margin of the sums; rows without a crop are left out."""
    measures = ["revenue", "cost", "profit_calc", "quantity_sold"]
    require_columns(df, [key, *measures])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in measures])
        .transform(with_margin)
    )
