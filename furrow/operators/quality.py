"""Data-quality report: one rule table, one aggregate, one row per measured value."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import fixed_values as fixed
from furrow.operators.checks import missing_columns
from furrow.operators.features import with_crop_facts
from furrow.operators.ordering import exact_quantiles
from furrow.operators.stats import (
    category_shares,
    correlations,
    extreme_keys,
    id_gaps,
    iqr_outliers,
    table_shape,
)

class Rule(NamedTuple):
    """``value`` is an aggregate in Spark SQL, ``needs`` the columns it reads."""

    section: str
    name: str
    needs: tuple[str, ...]
    value: str


def _ratio(a: str, b: str) -> str:
    return f"try_divide({a}, {b} + 1e-6D)"


def _counts(section: str, rules: str) -> list[Rule]:
    """Lines of ``name | columns | condition``: number of records where it holds."""
    made = []
    for line in rules.strip().splitlines():
        name, needs, mask = (part.strip() for part in line.split("|", 2))
        made.append(Rule(section, name, tuple(needs.split()), f"count_if({mask})"))
    return made


def _mean(section: str, name: str, value: str, by: str, category: str) -> Rule:
    return Rule(section, name, (value, by), f"avg(if({by} = '{category}', {value}, null))")


def _domain_rules() -> list[Rule]:
    domains = {
        "crop_name": [row[1] for row in fixed.crop_rows()],
        "season": fixed.SEASONS,
        "market_location": fixed.LOCATIONS,
        "farm_location": fixed.LOCATIONS,
        "region_type": fixed.REGION_TYPES,
        "customer_type": fixed.CUSTOMER_TYPES,
        "demand_level": fixed.LEVELS,
        "supply_level": fixed.LEVELS,
        "sufficiency_status": fixed.SUFFICIENCY,
    }
    rules = []
    for name, allowed in domains.items():
        listed = ", ".join(f"'{value}'" for value in allowed)
        rules += _counts("categories", f"invalid_{name}_count | {name} | not coalesce({name} in ({listed}), false)")
    return rules


def _range_rules() -> list[Rule]:
    bounds = {
        "temperature": (5, 50), "humidity": (10, 100), "rainfall": (0, 150),
        "wind_speed": (0, 35), "demand_score": (0, 1), "supply_score": (0, 1),
    }
    lines = [f"{name}_negative_count | {name} | {name} < 0" for name in fixed.NON_NEGATIVE_COLUMNS]
    lines.append("area_size_too_large_count | area_size | area_size > 120")
    lines += [f"{n}_out_of_range_count | {n} | {n} < {low} or {n} > {high}" for n, (low, high) in bounds.items()]
    return _counts("ranges", "\n".join(lines))


def _planting_month_rule() -> list[Rule]:
    fits = " or ".join(
        f"(season = '{season}' and month(planting_date) in ({', '.join(map(str, months))}))"
        for season, months in fixed.SEASON_PLANTING_MONTHS.items()
    )
    return _counts(
        "planting_month", f"planting_month_out_of_season_count | season planting_date | not coalesce({fits}, false)"
    )


def _level_means() -> list[Rule]:
    return [
        _mean("levels", f"{side}_score_{level.lower()}_level_mean", f"{side}_score", f"{side}_level", level)
        for side in ("demand", "supply")
        for level in fixed.LEVELS
    ]


def _sufficiency_rules() -> list[Rule]:
    low, high = fixed.RATIO_CUTS
    ratio = "_score_ratio"
    wrong = {
        "shortage": f"(sufficiency_status = 'Shortage' and {ratio} >= {low + 1e-3}D)",
        "balanced": f"(sufficiency_status = 'Balanced' and ({ratio} < {low - 1e-3}D or {ratio} > {high + 1e-3}D))",
        "surplus": f"(sufficiency_status = 'Surplus' and {ratio} <= {high - 1e-3}D)",
    }
    wrong["total"] = " or ".join(wrong.values())
    needs = "sufficiency_status supply_score demand_score"
    lines = [f"sufficiency_{name}_rule_violation_count | {needs} | {mask}" for name, mask in wrong.items()]
    return _counts("sufficiency", "\n".join(lines))


def _pest_rules() -> list[Rule]:
    needs = ("pest_indicator", "humidity", "rainfall", "temperature")
    rate = "avg(if({}, cast(pest_indicator as double), null))"
    return [
        Rule("pests", "pest_rate_high_risk", needs, rate.format("_risky")),
        Rule("pests", "pest_rate_low_risk", needs, rate.format("not _risky")),
    ]


def _profit_shares() -> list[Rule]:
    share = "round(avg(cast(coalesce(profit {} 0, false) as double)) * 100, {})"
    return [
        Rule("profit", "positive_profit_pct", ("profit",), share.format(">", 2)),
        Rule("profit", "negative_profit_pct", ("profit",), share.format("<", 2)),
        Rule("profit", "zero_profit_pct", ("profit",), share.format("=", 4)),
        Rule("profit", "avg_profit", ("profit",), "avg(profit)"),
    ]


# Values that several rules share: computed once per record, before the aggregate.
DERIVED = {
    "_sold": _ratio("quantity_sold", "actual_yield"),
    "_per_area": _ratio("actual_yield", "area_size"),
    "_markup": _ratio("market_price", "unit_price"),
    "_margin": _ratio("profit", "total_sales"),
    "_per_km": _ratio("transport_cost", "distance_to_market"),
    "_fert_per_area": _ratio("fertilizer_used", "area_size"),
    "_water_per_area": _ratio("water_used", "area_size"),
    "_spent": _ratio("total_expenses", "total_sales"),
    "_grown": "datediff(harvest_date, planting_date)",
    "_kept": "datediff(sale_date, harvest_date)",
    "_risky": "coalesce(humidity > 60 or rainfall > 25 or temperature > 34, false)",
    "_score_ratio": (
        "bround(try_divide(least(greatest(supply_score * 0.92D + demand_score * 0.08D, 0D), 1D), demand_score + 1e-4D), 6)"
    ),
}

RULES: list[Rule] = [
    *_domain_rules(),
    *_counts("crop_season", "crop_season_mismatch_count | crop_name season | not coalesce(season = crop_season, false)"),
    *_counts("dates", """
        bad_date_order_count | planting_date harvest_date sale_date | planting_date >= harvest_date or harvest_date >= sale_date
        crop_duration_too_short_count | planting_date harvest_date | _grown < 30
        crop_duration_too_long_count | planting_date harvest_date | _grown > 250
        sale_gap_too_short_count | harvest_date sale_date | _kept < 1
        sale_gap_too_long_count | harvest_date sale_date | _kept > 45
    """),
    *_counts("crop_duration", """
        crop_duration_below_crop_min_count | crop_name planting_date harvest_date | _grown < days_lo
        crop_duration_above_crop_max_count | crop_name planting_date harvest_date | _grown > days_hi
    """),
    *_planting_month_rule(),
    *_range_rules(),
    *_counts("yield_sales", """
        quantity_sold_gt_actual_yield_count | quantity_sold actual_yield | quantity_sold > actual_yield + 1e-6D
        quantity_sold_equal_zero_count | quantity_sold | quantity_sold <= 0
        actual_yield_equal_zero_count | actual_yield | actual_yield <= 0
        sales_ratio_gt_1_count | quantity_sold actual_yield | _sold > 1
        sales_ratio_lt_0_75_count | quantity_sold actual_yield | _sold < 0.75D
        sales_ratio_gt_0_999_count | quantity_sold actual_yield | _sold > 0.999D
        yield_per_area_too_low_count | crop_name actual_yield area_size | _per_area < yield_lo * 0.5D
        yield_per_area_too_high_count | crop_name actual_yield area_size | _per_area > yield_hi * 2.8D
        yield_per_area_zero_count | actual_yield area_size | _per_area <= 0
    """),
    *_counts("prices", """
        unit_price_non_positive_count | unit_price | unit_price <= 0
        market_price_non_positive_count | market_price | market_price <= 0
        unit_price_too_low_vs_base_count | crop_name unit_price | unit_price < base_price * 0.6D
        unit_price_too_high_vs_base_count | crop_name unit_price | unit_price > base_price * 4D
        market_price_too_far_from_unit_price_count | market_price unit_price | _markup < 0.9D or _markup > 1.15D
        unit_price_gt_market_price_count | market_price unit_price | unit_price > market_price * 1.05D
    """),
    *_counts("finance", """
        profit_formula_mismatch_count | profit total_sales total_expenses | abs(profit - bround(total_sales - total_expenses, 2)) > 1
        total_sales_formula_mismatch_count | total_sales quantity_sold unit_price | abs(total_sales - bround(quantity_sold * unit_price, 2)) > 1
        profit_margin_gt_300pct_count | profit total_sales | _margin > 3
        profit_margin_lt_minus90pct_count | profit total_sales | _margin < -0.9D
        expenses_gt_5x_sales_count | total_expenses total_sales | _spent > 5
    """),
    *_counts("resources", """
        fertilizer_per_area_too_low_count | fertilizer_used area_size | _fert_per_area < 0.15D
        fertilizer_per_area_too_high_count | fertilizer_used area_size | _fert_per_area > 1
        water_per_area_too_low_count | water_used area_size | _water_per_area < 5
        water_per_area_too_high_count | water_used area_size | _water_per_area > 25
        transport_cost_zero_with_positive_distance_count | distance_to_market transport_cost | distance_to_market > 0 and transport_cost <= 0
        transport_per_km_too_low_count | transport_cost distance_to_market | _per_km < 0.005D
        transport_per_km_too_high_count | transport_cost distance_to_market | _per_km > 0.2D
    """),
    _mean("resources", "desert_avg_water_used", "water_used", "region_type", "Desert"),
    _mean("resources", "rural_avg_water_used", "water_used", "region_type", "Rural"),
    _mean("weather", "average_desert_temperature", "temperature", "region_type", "Desert"),
    _mean("weather", "average_rural_temperature", "temperature", "region_type", "Rural"),
    _mean("weather", "average_desert_rainfall", "rainfall", "region_type", "Desert"),
    _mean("weather", "average_rural_rainfall", "rainfall", "region_type", "Rural"),
    *_level_means(),
    *_pest_rules(),
    *_sufficiency_rules(),
    *_counts("booleans", "invalid_pest_indicator_type_count | pest_indicator | pest_indicator is null"),
    *_counts("profit", """
        positive_profit_count | profit | profit > 0
        negative_profit_count | profit | profit < 0
        zero_profit_count | profit | profit = 0
    """),
    *_profit_shares(),
]

# (section, flag) -> condition on measured values that raises the flag
ORDER_FLAGS = {
    ("resources", "desert_water_not_higher_than_rural_flag"): "desert_avg_water_used <= rural_avg_water_used",
    ("weather", "desert_not_hotter_than_rural_flag"): "average_desert_temperature <= average_rural_temperature",
    ("weather", "desert_not_drier_than_rural_flag"): "average_desert_rainfall >= average_rural_rainfall",
    ("pests", "pest_not_higher_in_high_risk_flag"): "pest_rate_high_risk <= pest_rate_low_risk",
    ("levels", "demand_level_order_issue_flag"): (
        "not (demand_score_low_level_mean < demand_score_medium_level_mean"
        " and demand_score_medium_level_mean < demand_score_high_level_mean)"
    ),
    ("levels", "supply_level_order_issue_flag"): (
        "not (supply_score_low_level_mean < supply_score_medium_level_mean"
        " and supply_score_medium_level_mean < supply_score_high_level_mean)"
    ),
}

CROP_FACTS = {"crop_season", "crop_duration", "yield_sales", "prices"}
# Rules in one aggregate: its buffers must stay under the 100 fields that code is generated for.
PART = 24
GROUPED = ["crop_name", "demand_level", "supply_level", "sufficiency_status", "customer_type", "region_type"]


def section_columns(*sections: str) -> list[str]:
    """Columns the rules of the sections read."""
    return sorted({n for r in RULES if r.section in sections for n in r.needs})


def with_shared_values(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The derived values the rules use."""
    words = {word for rule in rules for word in re.findall(r"\b_\w+", rule.value)}
    return df.selectExpr("*", *[f"{sql} as {name}" for name, sql in DERIVED.items() if name in words])


def rule_values(df: DataFrame, *sections: str) -> DataFrame:
    """(section, rule, value) of the chosen sections, from one scan per part of the rules.

    A single aggregate of all rules is too wide for generated code and takes several times as long.

    A flag whose means are missing is raised only where an order was required.
    """
    rules = [r for r in RULES if not sections or r.section in sections]
    flags = {key: test for key, test in ORDER_FLAGS.items() if not sections or key[0] in sections}
    return _all([_measured(df, part, flags) for part in _parts(rules)])


def _parts(rules: Sequence[Rule]) -> list[list[Rule]]:
    """The rules by whole sections, at most about ``PART`` together."""
    parts: list[list[Rule]] = []
    for _, section in groupby(rules, lambda r: r.section):
        named = [*section]
        if parts and len(parts[-1]) + len(named) <= PART:
            parts[-1] += named
        else:
            parts.append(named)
    return parts


def _measured(df: DataFrame, rules: Sequence[Rule], flags: dict[tuple[str, str], str]) -> DataFrame:
    """The rules' values, and the flags of their sections, from one aggregate."""
    sections = {r.section for r in rules}
    records = with_shared_values(with_crop_facts(df) if CROP_FACTS & sections else df, rules)
    row = records.selectExpr(*[f"cast({r.value} as double) as {r.name}" for r in rules])
    flags = {key: test for key, test in flags.items() if key[0] in sections}
    if flags:
        raised = [
            f"cast(coalesce({test}, {str(section == 'levels').lower()}) as double) as {name}"
            for (section, name), test in flags.items()
        ]
        row = row.selectExpr("*", *raised)
    return _long(row, [(r.section, r.name, r.name) for r in rules] + [(s, n, n) for s, n in flags])


def _long(row: DataFrame, named: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One-row result -> a row per (section, rule, column)."""
    cells = ", ".join(f"'{section}', '{rule}', cast({col} as double)" for section, rule, col in named)
    return row.selectExpr(f"stack({len(named)}, {cells}) as (section, rule, value)")


def as_rules(row: DataFrame, section: str, names: dict[str, str]) -> DataFrame:
    return _long(row, [(section, rule, col) for col, rule in names.items()])


def overview(df: DataFrame) -> DataFrame:
    names = ["row_count", "column_count", "missing_values_total", "duplicate_rows"]
    return as_rules(table_shape(df), "overview", {n: n for n in names})


def record_ids(df: DataFrame) -> DataFrame:
    names = {
        "is_unique": "record_id_unique", "duplicates": "record_id_duplicates", "lowest": "record_id_min",
        "highest": "record_id_max", "missing_in_range": "record_id_missing_sequence_count",
    }
    return as_rules(id_gaps(df), "record_id", names)


def required_columns(df: DataFrame) -> DataFrame:
    """Each required column and whether it is missing: not there, or without any value."""
    absent = set(missing_columns(df, fixed.REQUIRED_COLUMNS))
    flags = {
        name: F.lit(1.0) if name in absent else (F.count(name) == 0).cast("double") for name in fixed.REQUIRED_COLUMNS
    }
    row = df.agg(*[flag.alias(f"missing_{name}") for name, flag in flags.items()])
    names = [f"missing_{name}" for name in flags]
    total = " + ".join(names)
    return as_rules(
        row.selectExpr("*", f"{total} as missing_required_columns_count"), "required", {n: n for n in [*names, "missing_required_columns_count"]}
    )


def combined_groups(df: DataFrame) -> DataFrame:
    """Counts and sums per combination of categories: one scan serves every share and mean."""
    return df.groupBy(*GROUPED).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("profit").alias("profit"),
        F.count("profit").alias("n_profit"),
        F.sum("total_sales").alias("sales"),
        F.count("total_sales").alias("n_sales"),
    )


def distributions(groups: DataFrame) -> DataFrame:
    """(attribute, category, n, share_pct) for each categorical attribute."""
    cells = ", ".join(f"'{name}', {name}, n" for name in GROUPED)
    long = groups.selectExpr(f"stack({len(GROUPED)}, {cells}) as (attribute, category, n)").where("category is not null")
    counts = long.groupBy("attribute", "category").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("attribute").agg(F.sum("n").alias("_total"))  # one row per attribute
    shares = counts.join(F.broadcast(totals), "attribute")
    return shares.selectExpr("attribute", "category", "n", "n / _total * 100 as share_pct")


def share_rules(groups: DataFrame) -> DataFrame:
    """The share of every category as report rows."""
    return distributions(groups).select(
        F.lit("distribution").alias("section"), F.concat_ws("_", "attribute", "category", F.lit("share_pct")).alias("rule"),
        F.col("share_pct").alias("value"),
    )


def group_rules(groups: DataFrame) -> DataFrame:
    """The highest and lowest mean of each group check as report rows."""
    found = group_means(groups).groupBy("attribute", "measure").agg(F.max("mean").alias("max"), F.min("mean").alias("min"))
    return found.selectExpr("attribute", "measure", "stack(2, 'max', max, 'min', min) as (which, value)").select(
        F.lit("groups").alias("section"), F.concat_ws("_", "attribute", "measure", F.lit("mean"), "which").alias("rule"), "value"
    )


def group_checks(groups: DataFrame) -> DataFrame:
    """(attribute, measure, lowest, highest): categories with the extreme means."""
    return extreme_keys(group_means(groups), "category", ["attribute", "measure"]).select("attribute", "measure", "lowest", "highest")


def group_means(groups: DataFrame) -> DataFrame:
    """(attribute, measure, category, mean) of the measures that are compared between groups."""
    checks = (("crop_name", "profit", "n_profit"), ("region_type", "profit", "n_profit"), ("customer_type", "sales", "n_sales"))
    cells = ", ".join(f"'{key}', '{total}', {key}, {total}, {n}" for key, total, n in checks)
    long = groups.selectExpr(f"stack({len(checks)}, {cells}) as (attribute, measure, category, total, n)")
    return long.where("category is not null").groupBy("attribute", "measure", "category").agg(
        F.try_divide(F.sum("total"), F.sum("n")).alias("mean")
    )


def crop_share_extremes(df: DataFrame) -> DataFrame:
    shares = category_shares(df, "crop_name").agg(F.max("share_pct").alias("hi"), F.min("share_pct").alias("lo"))
    return as_rules(shares, "distribution", {"hi": "crop_max_share_pct", "lo": "crop_min_share_pct"})


def pair_correlations(df: DataFrame) -> DataFrame:
    return correlations(df, fixed.CORRELATION_PAIRS).select(
        F.lit("correlation").alias("section"), F.col("pair").alias("rule"), F.col("corr").alias("value")
    )


def outliers(df: DataFrame) -> DataFrame:
    """Outlier counts per column, and the median profit that comes with the quartiles."""
    found = iqr_outliers(df, fixed.OUTLIER_COLUMNS)
    return found.select(
        F.lit("outliers").alias("section"),
        F.concat("column_name", F.lit("_outlier_count_iqr")).alias("rule"),
        F.col("outliers").cast("double").alias("value"),
    )


WARNINGS: dict[str, list[str]] = {
    "has_missing_values": ["missing_values_total"],
    "has_duplicate_rows": ["duplicate_rows"],
    "has_invalid_categories": [r.name for r in RULES if r.section == "categories"],
    "has_bad_date_order": ["bad_date_order_count"],
    "has_sales_yield_issue": ["quantity_sold_gt_actual_yield_count"],
    "has_score_range_issue": ["demand_score_out_of_range_count", "supply_score_out_of_range_count"],
    "has_price_issues": [
        "unit_price_non_positive_count", "market_price_non_positive_count",
        "unit_price_too_low_vs_base_count", "unit_price_too_high_vs_base_count",
    ],
    "has_profit_formula_issues": ["profit_formula_mismatch_count"],
    "has_sufficiency_rule_issues": ["sufficiency_total_rule_violation_count"],
    "demand_level_order_issue": ["demand_level_order_issue_flag"],
    "supply_level_order_issue": ["supply_level_order_issue_flag"],
    "desert_temp_logic_issue": ["desert_not_hotter_than_rural_flag"],
    "desert_water_logic_issue": ["desert_water_not_higher_than_rural_flag"],
    "pest_logic_issue": ["pest_not_higher_in_high_risk_flag"],
}


def warning_flags(values: DataFrame) -> DataFrame:
    """(flag, raised) from measured values; a flag is raised by any positive value."""
    raised = []
    for flag, names in WARNINGS.items():
        listed = ", ".join(f"'{name}'" for name in names)
        raised.append(f"coalesce(bool_or(rule in ({listed}) and value > 0), false) as {flag}")
    cells = ", ".join(f"'{flag}', {flag}" for flag in WARNINGS)
    return values.selectExpr(*raised).selectExpr(f"stack({len(WARNINGS)}, {cells}) as (flag, raised)")


def median_profit(df: DataFrame) -> DataFrame:
    found = exact_quantiles(df, ["profit"], [0.5])
    return found.select(F.lit("profit").alias("section"), F.lit("median_profit").alias("rule"), F.col("q0").alias("value"))


def report(df: DataFrame) -> DataFrame:
    """Every numeric value of the report as (section, rule, value)."""
    groups = combined_groups(df)
    return _all(
        [
            overview(df),
            record_ids(df),
            required_columns(df),
            rule_values(df),
            crop_share_extremes(df),
            share_rules(groups),
            group_rules(groups),
            pair_correlations(df),
            outliers(df),
            median_profit(df),
        ]
    )


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
