"""Group statistics, profiles and global scaling, each in one or two passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import fixed_values as fixed
from furrow.operators.joins import lookup_join, one_row
from furrow.operators.ordering import exact_quantiles, sequential_ids
from furrow.session import cut_lineage
from furrow.functions.scalars import at_least, in_set, pct_true


def group_sums(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Sums per key; null keys left out, a group without values sums to 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*sums)


def crop_baselines(df: DataFrame, key: str = "crop_name", more: Mapping[str, Column] | None = None) -> DataFrame:
    """Average price, per-area rates and supply score per crop, missing ones 0; ``more`` aggregates as they are."""
    averages = {
        "market_price": F.avg("market_price"),
        "yield_per_ha": F.avg(F.try_divide("actual_yield", "area_size")),
        "fertilizer_per_ha": F.avg(F.try_divide("fertilizer_used", "area_size")),
        "water_per_ha": F.avg(F.try_divide("water_used", "area_size")),
        "supply": F.avg("supply_score"),
    }
    found = [F.coalesce(c, F.lit(0.0)).alias(n) for n, c in averages.items()]
    return df.groupBy(key).agg(*found, *[c.alias(n) for n, c in (more or {}).items()])


def per_area_medians(df: DataFrame, crops: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Median water and fertilizer per area of the chosen crops."""
    area = at_least(F.col("area_size"), fixed.EPS)
    rates = (df if crops is None else df.where(F.col("crop_name").isin(list(crops)))).select(
        "crop_name",
        F.try_divide("water_used", area).alias("water_per_area"),
        F.try_divide("fertilizer_used", area).alias("fert_per_area"),
    )
    names = ["water_per_area", "fert_per_area"]
    if approximate:
        return rates.groupBy("crop_name").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in names])
    medians = exact_quantiles(rates, names, [0.5], keys=["crop_name"])
    pick = [F.max(F.when(F.col("measure") == c, F.col("q0"))).alias(c) for c in names]
    return medians.groupBy("crop_name").agg(*pick)


def group_extremes(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with the lowest and highest mean; the first key in order wins a tie."""
    means = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("mean"))
    return extreme_keys(means, key)


def extreme_keys(means: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    means = means.where(F.col("mean").isNotNull())
    return means.groupBy(*by).agg(
        F.min_by(key, F.struct(F.col("mean"), F.col(key))).alias("lowest"),
        F.min("mean").alias("lowest_mean"),
        F.min_by(key, F.struct(-F.col("mean"), F.col(key))).alias("highest"),
        F.max("mean").alias("highest_mean"),
    )


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def category_shares(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage of each category among rows that have one."""
    return with_share(count_by(df.where(F.col(key).isNotNull()), key))


def with_share(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n").alias("_total"))
    return one_row(counts, total).withColumn("share_pct", F.try_divide("n", "_total") * 100).drop("_total")


def latest_per_key(df: DataFrame, key: str, order: Sequence[str], value: str, alias: str = "latest") -> DataFrame:
    """Value of the last row per key; works as a batch and as a streaming aggregate."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(alias))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: number of distinct non-null values."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("m")
    ).select("m.*")
    unique = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return unique.groupBy("column_name").agg(F.count("v").alias("n_distinct"))


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: type and number of missing values."""
    counts = df.selectExpr(*[f"count_if(`{c}` is null) as `{c}`" for c in df.columns])
    cells = ", ".join(f"'{c}', '{t}', `{c}`" for c, t in df.dtypes)
    return counts.selectExpr(f"stack({len(df.columns)}, {cells}) as (column_name, data_type, nulls)")


def table_shape(df: DataFrame) -> DataFrame:
    """Row and column count, missing values, rows that repeat an earlier one.

    Equal rows meet by 128 bits of hashes, not by all their columns: 16 bytes a row are shuffled.
    Which columns are null is hashed too, as hashes pass over nulls.
    """
    missing = F.expr(" + ".join(f"if(`{c}` is null, 1, 0)" for c in df.columns))
    parts = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    marked = df.select(F.xxhash64(*parts).alias("_a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("_b"), missing.alias("_missing"))
    copies = marked.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_missing").alias("_missing"))
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_values_total"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def summary_numbers(df: DataFrame, column: str, masks: Mapping[str, Column]) -> DataFrame:
    """Min, max, mean and conditional means of a column in one pass."""
    return df.agg(
        F.min(column).alias("lowest"),
        F.max(column).alias("highest"),
        F.avg(column).alias("mean"),
        *[F.avg(F.when(mask, F.col(column))).alias(name) for name, mask in masks.items()],
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows outside 1.5 interquartile ranges, one line per column. The columns are stored once for the three scans."""
    df = cut_lineage(df.select(*columns))
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    reach = (F.col("q1") - F.col("q0")) * 1.5
    bounds = quartiles.select(
        F.col("measure").alias("column_name"), "q0", "q1", (F.col("q0") - reach).alias("low"), (F.col("q1") + reach).alias("high")
    )
    # one row that holds the bounds of all columns, so the table is scanned once
    wide = bounds.selectExpr(
        *[f"max(if(column_name = '{c}', {e}, null)) as _{c}_{e}" for c in columns for e in ("low", "high")]
    )
    outside = one_row(df.select(*columns), wide).selectExpr(
        *[f"count_if({c} < _{c}_low or {c} > _{c}_high) as {c}" for c in columns]
    )
    cells = ", ".join(f"'{c}', {c}" for c in columns)
    counts = outside.selectExpr(f"stack({len(columns)}, {cells}) as (column_name, outliers)")
    return counts.join(F.broadcast(bounds), "column_name", "left")


def correlations(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Pearson correlation of each named pair, all in one aggregate; null for a constant column."""
    both = "stddev_pop({0}) filter (where {1} is not null)"
    row = df.selectExpr(
        *[f"try_divide(covar_pop({a}, {b}), {both.format(a, b)} * {both.format(b, a)}) as {n}" for n, (a, b) in pairs.items()]
    )
    cells = ", ".join(f"'{name}', {name}" for name in pairs)
    return row.selectExpr(f"stack({len(pairs)}, {cells}) as (pair, corr)")


def true_shares(df: DataFrame, masks: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[pct_true(mask).alias(name) for name, mask in masks.items()])


def with_group_mean(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Mean of the row's group on every row.

    An aggregate and a lookup instead of a window: a window would pull each group,
    however large, into one task.
    """
    means = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(name))
    return lookup_join(df, means, [key])


def with_min_max(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Scale columns over the whole table: (x - min) / (max - min + 1e-6)."""
    bounds = df.agg(*[f(c).alias(f"_{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    scaled = {
        out: (F.col(c) - F.col(f"_{c}_min")) / (F.col(f"_{c}_max") - F.col(f"_{c}_min") + fixed.EPS)
        for c, out in columns.items()
    }
    return one_row(df, bounds).withColumns(scaled).drop(*bounds.columns)


def with_max_ratio(df: DataFrame, column: str, name: str) -> DataFrame:
    """x over the table's maximum, which counts as 1 when smaller."""
    top = df.agg(F.greatest(F.max(column), F.lit(1)).alias("_top"))
    return one_row(df, top).withColumn(name, F.col(column) / F.col("_top")).drop("_top")


def id_gaps(df: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Uniqueness, range and number of ids missing from the range.

    Ids are counted per value first, so a repeated id costs one row after the combine.
    """
    per_id = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    repeats = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
    return per_id.agg(
        (repeats == 0).alias("is_unique"),
        repeats.alias("duplicates"),
        F.min(id_col).alias("lowest"),
        F.max(id_col).alias("highest"),
        (F.max(id_col) - F.min(id_col) + 1 - F.count(id_col)).alias("missing_in_range"),
    )


def missing_ranges(df: DataFrame, id_col: str = "record_id") -> DataFrame:
    """(first, last) of every run of ids that are missing between two present ones."""
    present = df.select(F.col(id_col).cast("long").alias("_id")).where("_id is not null").distinct()
    placed = sequential_ids(present, ["_id"], "_place")
    after = placed.select((F.col("_place") - 1).alias("_place"), F.col("_id").alias("_next"))
    gaps = placed.join(after, "_place").where("_next - _id > 1")
    return gaps.selectExpr("_id + 1 as first", "_next - 1 as last")


def missing_ids(df: DataFrame, id_col: str = "record_id") -> DataFrame:
    """The ids themselves, from the gaps alone; a wide gap is unfolded in steps of 2^20, never as one array."""
    step = 1 << 20
    rows = missing_ranges(df, id_col)
    for size in (step * step, step, 1):
        parts = rows.select("last", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(last - first) div {size}L"))).alias("_part"), "first")
        rows = parts.selectExpr(f"first + _part * {size}L as first", f"least(last, first + _part * {size}L + {size}L - 1) as last")
    return rows.select(F.col("first").alias(id_col))


def outside_domain(df: DataFrame, domains: Mapping[str, Sequence]) -> DataFrame:
    """Rows whose value is not allowed, per column; missing values count as invalid."""
    row = df.agg(*[F.count_if(~in_set(F.col(c), allowed)).alias(c) for c, allowed in domains.items()])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("invalid")) for c in domains]
    return row.select(F.explode(F.array(*entries)).alias("m")).select("m.*")


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Report of the first n rows; Spark keeps n rows per task, never a full sort."""
    return df.orderBy(*order).limit(n)
