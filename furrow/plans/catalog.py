"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furrow import fixed_values as fixed
from furrow.functions import scalars as s
from furrow.operators import allocation, checks, enrich, features, finance, joins, linear, ml, moments, ordering, quality, reshape, scoring, stats
from furrow.plans import etl, inputs
from furrow.plans.farm_view import farm_records, table
from furrow.schemas import EVENTS, FARM_RECORD
from furrow.session import TASK_ROWS, cut_lineage, few_tasks, scratch_path
from furrow.sources import government, tables, whole_files
from furrow.sources import models as models_
from furrow.streaming.latest import latest_of_stream
from furrow.streaming.scoring import scored_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FINANCE = ["record_id", "crop_name", "quantity_sold", "unit_price", "total_sales", "total_expenses", "transport_cost", "profit"]
MEDIAN_CROPS = ["Tomato", "Potato", "Rice", "Wheat", "Onion", "Brand#25"]
AREA_INPUTS = ["area_size", "actual_yield", "water_used", "fertilizer_used"]
CLIMATE = ["temperature", "wind_speed", "rainfall", "pest_indicator"]
DEMAND_INPUTS = [
    "record_id", "crop_name", "quantity_sold", "actual_yield", "market_price", "sale_gap_days", "customer_type",
    "market_location", "inventory_remaining",
]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _round(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- finance --------------------------------------------------------------------------


@query
def summary_by_crop(spark, sf):
    metrics = finance.finance_metrics(farm_records(spark, sf, FINANCE))
    return _round(finance.summary_by_crop(metrics), 4, "revenue", "cost", "profit_calc", "quantity_sold", "profit_margin_pct")


@query
def revenue_lines(spark, sf):
    rows = farm_records(spark, sf, ["record_id", "quantity_sold", "unit_price", "total_sales"])
    return finance.with_revenue(rows).select("record_id", "computed_revenue", "revenue")


@query
def cost_profit_margin(spark, sf):
    rows = farm_records(spark, sf, FINANCE)
    return finance.finance_metrics(rows).select("record_id", "cost", "profit_calc", "profit_diff", "profit_margin_pct")


@query
def cost_without_transport(spark, sf):
    rows = farm_records(spark, sf, FINANCE)
    return finance.finance_metrics(rows, include_transport=False).select("record_id", "cost", "profit_calc")


@query
def efficiency(spark, sf):
    rows = farm_records(spark, sf, ["record_id", "actual_yield", "water_used", "fertilizer_used"])
    return finance.with_efficiency(rows).select("record_id", "water_efficiency", "fertilizer_efficiency")


# --- statistics -----------------------------------------------------------------------


@query
def crop_sums(spark, sf):
    rows = farm_records(spark, sf, ["customer_type", "total_sales", "total_expenses"])
    return _round(stats.group_sums(rows, "customer_type", ["total_sales", "total_expenses"]), 4, "total_sales", "total_expenses")


@query
def crop_baselines(spark, sf):
    return _round(_baselines(spark, sf), 6, "market_price", "yield_per_ha", "fertilizer_per_ha", "water_per_ha", "supply")


def _baselines(spark, sf):
    return stats.crop_baselines(farm_records(spark, sf, ["crop_name", "market_price", *AREA_INPUTS, "supply_score"]))


@query
def crop_medians(spark, sf):
    rows = farm_records(spark, sf, ["crop_name", "area_size", "water_used", "fertilizer_used"])
    return _round(stats.per_area_medians(rows, MEDIAN_CROPS), 9, "water_per_area", "fert_per_area")


@query
def group_extremes(spark, sf):
    return quality.group_checks(_groups(spark, sf))


def _groups(spark, sf):
    return quality.combined_groups(farm_records(spark, sf, [*quality.GROUPED, "profit", "total_sales"]))


@query
def category_shares(spark, sf):
    return _round(quality.distributions(_groups(spark, sf)), 6, "share_pct")


@query
def label_counts(spark, sf):
    return stats.count_by(farm_records(spark, sf, ["demand_level"]), "demand_level")


@query
def latest_per_key(spark, sf):
    return stats.latest_per_key(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")


@query
def distinct_profile(spark, sf):
    names = ["crop_name", "season", "region_type", "market_location", "customer_type", "demand_level"]
    return stats.distinct_counts(farm_records(spark, sf, names), names)


@query
def null_profile(spark, sf):
    names = ["crop_name", "customer_type", "total_sales", "water_efficiency", "fertilizer_efficiency", "profit"]
    return stats.null_profile(farm_records(spark, sf, names)).select("column_name", "nulls")


@query
def conditional_means(spark, sf):
    masks = {
        "mean_desert": F.col("region_type") == "Desert",
        "mean_rural": F.col("region_type") == "Rural",
        "mean_pest": F.col("pest_indicator"),
    }
    rows = farm_records(spark, sf, ["profit", "region_type", "pest_indicator"])
    return _round(stats.summary_numbers(rows, "profit", masks), 6, "lowest", "highest", "mean", *masks)


@query
def true_shares(spark, sf):
    masks = {"pest_pct": F.col("pest_indicator"), "loss_pct": F.col("profit") < 0, "no_sales_pct": F.col("total_sales").isNull()}
    return stats.true_shares(farm_records(spark, sf, ["pest_indicator", "profit", "total_sales"]), masks)


@query
def iqr_outliers(spark, sf):
    rows = farm_records(spark, sf, fixed.OUTLIER_COLUMNS)
    return _round(stats.iqr_outliers(rows, fixed.OUTLIER_COLUMNS), 6, "q0", "q1", "low", "high")


@query
def correlations(spark, sf):
    names = sorted({c for pair in fixed.CORRELATION_PAIRS.values() for c in pair})
    return _round(stats.correlations(farm_records(spark, sf, names), fixed.CORRELATION_PAIRS), 9, "corr")


@query
def correlation_matrix(spark, sf):
    """All pairs of the numeric columns, from one state."""
    return _round(moments.correlation_matrix(farm_records(spark, sf, fixed.CORRELATED), fixed.CORRELATED), 9, "corr")


@query
def relative_price(spark, sf):
    rows = features.with_relative_price(farm_records(spark, sf, ["record_id", "crop_name", "market_price"]))
    return _round(rows, 9, "relative_price_index").select("record_id", "crop_name", "relative_price_index")


@query
def minmax_scores(spark, sf):
    rows = farm_records(spark, sf, ["record_id", "area_size", "profit"])
    scaled = stats.with_min_max(rows, {"area_size": "area_scaled", "profit": "profit_scaled"})
    return _round(scaled.select("record_id", "area_scaled", "profit_scaled"), 9, "area_scaled", "profit_scaled")


@query
def id_gaps(spark, sf):
    return stats.id_gaps(farm_records(spark, sf, ["record_id"]))


@query
def missing_ids(spark, sf):
    return stats.missing_ids(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id")))


@query
def domain_violations(spark, sf):
    domains = {"region_type": fixed.REGION_TYPES, "customer_type": fixed.CUSTOMER_TYPES, "farm_location": fixed.LOCATIONS}
    return stats.outside_domain(farm_records(spark, sf, list(domains)), domains)


@query
def first_rows(spark, sf):
    rows = farm_records(spark, sf, ["record_id", "crop_name", "profit"])
    return stats.top_rows(rows, [F.desc("profit"), F.col("record_id"), F.col("crop_name")], 15)


# --- scalars and features -------------------------------------------------------------


@query
def date_parts(spark, sf):
    rows = s.date_parts(farm_records(spark, sf, ["record_id", "planting_date", "sale_date"]), "planting_date", "sale_date")
    parts = [f"{p}_{u}" for p in ("planting", "sale") for u in ("year", "month", "day")]
    return rows.select("record_id", *[F.col(c).cast("long").alias(c) for c in parts])


@query
def ordinal_levels(spark, sf):
    rows = farm_records(spark, sf, ["record_id", "demand_level", "demand_score", "supply_score"])
    return rows.select(
        "record_id",
        s.level_ordinal(F.col("demand_level")).cast("long").alias("demand_ord"),
        s.level_from_score(F.col("demand_score"), fixed.DEMAND_CUTS).alias("demand_by_score"),
        s.level_from_score(F.col("supply_score"), fixed.SUPPLY_CUTS).alias("supply_by_score"),
    )


@query
def demand_pressure(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_quantity as supply", "l_discount * 500D as demand")
    supply, demand = F.col("supply"), F.col("demand")
    return rows.select(
        "l_orderkey",
        s.demand_pressure(supply, demand).cast("long").alias("demand_level_ord"),
        s.sufficiency_by_balance(supply, demand).alias("status"),
    )


@query
def sufficiency_score(spark, sf):
    rows = farm_records(spark, sf, ["record_id", "supply_score", "demand_score"])
    return features.with_sufficiency(rows).select("record_id", "sufficiency_status")


@query
def sale_gap(spark, sf):
    rows = farm_records(spark, sf, ["record_id", "sale_date"])
    gap = s.sale_gap(F.col("sale_date"), F.lit(inputs.AS_OF).cast("date"))
    return rows.select("record_id", gap.cast("long").alias("sale_gap_days"))


@query
def fallbacks(spark, sf):
    rows = farm_records(spark, sf, ["record_id", "crop_name", "water_used", "area_size"]).selectExpr(
        "record_id", "crop_name", "water_used as supply", "area_size as area_donums"
    )
    based = enrich.with_area(enrich.with_baselines(rows, _baselines(spark, sf)))
    return _round(based, 6, "supply", "market_price", "fertilizer_used", "water_used").select(
        "record_id", "supply", "market_price", "fertilizer_used", "water_used"
    )


@query
def split_crops(spark, sf):
    return enrich.candidate_crops(inputs.crop_list_requests(spark, sf)).select(
        "request_id", F.col("position").cast("long").alias("position"), "crop_name"
    )


@query
def kind_clean(spark, sf):
    raw = table(spark, sf, "part").selectExpr(
        "p_partkey", "concat('  ', p_name, if(p_size % 3 = 0, ' AREA', if(p_size % 3 = 1, ' Production t', '')), ' ') as label",
        "if(p_size % 5 = 0, 'n/a', concat(p_size, ',', '500.5')) as number",
    )
    return raw.select(
        "p_partkey", s.canonical_kind(s.normal_text(F.col("label"))).alias("kind"),
        s.zero_to_null(s.number_or_zero(F.col("number"))).alias("number"),
    )


@query
def yield_price_factors(spark, sf):
    names = ["record_id", "area_size", "region_type", *CLIMATE, "humidity", "customer_type", "market_location", "unit_price"]
    c = F.col
    rows = farm_records(spark, sf, names)
    potential = features.potential_yield(c("area_size"), F.lit(2.0), c("region_type"), c("rainfall"))
    loss = F.when(c("pest_indicator"), 0.8).otherwise(1.0)
    price = features.composed_price(c("unit_price") / 10, c("market_location"), c("customer_type"), F.lit(1.1))
    made = rows.select(
        "record_id",
        features.pest_probability(c("humidity"), c("rainfall"), c("temperature")).alias("pest_probability"),
        potential.alias("potential_yield"),
        features.composed_yield(potential, c("temperature"), c("wind_speed"), loss).alias("actual_yield"),
        features.water_need(c("area_size"), F.lit(10.0), c("region_type")).alias("water_used"),
        price.alias("unit_price"),
    )
    return _round(made, 9, "pest_probability", "potential_yield", "actual_yield", "water_used", "unit_price")


@query
def expense_parts(spark, sf):
    rows = farm_records(spark, sf, ["record_id", "crop_name", "area_size", "water_used", "fertilizer_used", "quantity_sold", "transport_cost", "unit_price", "planting_date"])
    c = F.col
    parts = [c("area_size") * 1.0, c("water_used") * 0.01, c("fertilizer_used") * 0.2, c("area_size") * 0.5, c("area_size") * 0.1, c("quantity_sold") * 0.01, c("transport_cost")]
    spent = features.total_expenses(*parts)
    sold = c("quantity_sold") * c("unit_price")
    known = features.with_crop_facts(rows)
    harvest, sale = features.harvest_and_sale(c("planting_date"), c("days_lo"), F.lit(5))
    made = known.select("record_id", spent.alias("total_expenses"), (sold - spent).alias("profit"), harvest.alias("harvest_date"), sale.alias("sale_date"), "crop_category")
    return features.rounded(made, {"total_expenses": 6, "profit": 6})


@query
def demand_score(spark, sf):
    rows = cut_lineage(farm_records(spark, sf, DEMAND_INPUTS))
    scored = features.with_demand_score(rows)
    return _round(scored, 8, "demand_score", "relative_price_index").select("record_id", "relative_price_index", "demand_score")


@query
def supply_score(spark, sf):
    rows = cut_lineage(farm_records(spark, sf, ["record_id", *AREA_INPUTS, *CLIMATE]))
    scored = _round(features.with_supply_score(rows), 8, "supply_score")
    return scored.select("record_id", F.col("climate_penalty").cast("long").alias("climate_penalty"), "supply_score")


# --- statistics files -----------------------------------------------------------------


def _production(spark, sf):
    wide = inputs.production_wide(spark, sf)
    return etl.clean_production(wide, inputs.years_of(wide))


def _prices(spark, sf, **options):
    wide = inputs.prices_wide(spark, sf)
    return etl.clean_prices(wide, inputs.years_of(wide), **options)


@query
def melt_years(spark, sf):
    wide = inputs.production_wide(spark, sf)
    names = ["kind", "season", "crop", "location"]
    clean = wide.withColumns({c: s.normal_text(F.col(c)) for c in names})
    long = reshape.melt_years(clean.withColumn("kind", s.canonical_kind(F.col("kind"))), names, inputs.years_of(wide))
    return long.withColumn("year", F.col("year").cast("long"))


@query
def pivot_kinds(spark, sf):
    return _production(spark, sf).withColumn("year", F.col("year").cast("long"))


@query
def pivot_first(spark, sf):
    return _season_production(spark, sf)


def _season_production(spark, sf):
    names = {"Area": "area_size", "Production": "total_yield"}
    return reshape.pivot_first(inputs.season_rows(spark, sf), ["season", "crop", "location"], "metric", "value_2024", "line_no", names)


@query
def monthly_expand(spark, sf):
    months = reshape.to_months(_production(spark, sf))
    return months.select("crop", "location", "season", F.col("year").cast("long").alias("year"), "month", F.round("monthly_yield_est", 9).alias("monthly_yield_est"))


@query
def season_explode(spark, sf):
    months = reshape.to_season_months(_season_production(spark, sf))
    return months.select("season", "crop", "location", "month", F.round("monthly_yield_est", 9).alias("monthly_yield_est"))


@query
def metric_filter(spark, sf):
    wide = inputs.prices_wide(spark, sf)
    kept = etl.price_rows(wide).select(F.lit("any price").alias("rule"), "metric", "crop")
    one = etl.one_metric(wide, etl.FARM_GATE).select(F.lit("one metric").alias("rule"), "metric", "crop")
    none = etl.price_rows(wide.where("metric = 'Packs'")).select(F.lit("no price").alias("rule"), "metric", "crop")
    return kept.unionByName(one).unionByName(none).groupBy("rule", "metric", "crop").agg(F.count(F.lit(1)).alias("n"))


def _priced(spark, sf, **options):
    return etl.monthly_prices(_production(spark, sf), _prices(spark, sf, **options), inputs.price_regions(spark, sf))


@query
def price_fallback_join(spark, sf):
    priced = _priced(spark, sf)
    return priced.select("crop", "location", "season", F.col("year").cast("long").alias("year"), "month", "price_region", "price", "price_kingdom", "final_price")


@query
def price_fan_out(spark, sf):
    """Every price metric joins, so months repeat."""
    priced = _priced(spark, sf, faithful=True)
    return priced.groupBy("crop", F.col("year").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("final_price").alias("price_sum"))


@query
def etl_output(spark, sf):
    table_a = etl.numbered_sales(etl.monthly_sales(_priced(spark, sf)))
    rounded = _round(table_a, 9, "quantity_sold_kg", "unit_price_jod").withColumn("total_sales_jod", F.round("total_sales_jod", 6))
    return rounded.withColumn("year", F.col("year").cast("long"))


@query
def season_output(spark, sf):
    priced = etl.season_prices(_season_production(spark, sf), inputs.season_price_rows(spark, sf), inputs.season_regions(spark, sf))
    made = etl.season_sales(priced)
    kept = ["record_id", "crop_name", "season", "month", "farm_location", "region_type", "area_size", "quantity_sold", "unit_price", "total_sales", "market_price", "expense_type"]
    return _round(made.select(*kept), 6, "quantity_sold", "unit_price", "total_sales", "market_price")


@query
def government_files(spark, sf):
    """Write the production table as untidy text files, read it back and clean it."""
    wide = inputs.production_wide(spark, sf)
    years = inputs.years_of(wide)
    line = F.concat_ws(";", *[F.concat(F.lit('"'), F.coalesce(F.col(c), F.lit("")), F.lit('"')) for c in ["kind", "season", "crop", "location", *years]], F.lit(""))
    folder = scratch_path(spark, "statistics")
    wide.select(line.alias("value")).write.text(folder)
    header = ["Title of the table", "", "KIND;Season;Crop;Level;" + ";".join(years) + ";"]
    spark.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.mode("append").text(folder)
    fields = ["kind", "season", "crop", "location", *years]
    return etl.clean_production(government.read_table(spark, folder, fields), years).withColumn("year", F.col("year").cast("long"))


def _as_files(df, heading, encoding="UTF-8"):
    """The rows as untidy files: quoted fields, a trailing delimiter, a title and a heading in each."""
    spark, folder = df.sparkSession, scratch_path(df.sparkSession, "statistics")
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns], F.lit("").alias("_end"))
    text.write.options(sep=";", quoteAll=True, emptyValue="", encoding=encoding).csv(folder)
    lines = spark.createDataFrame([("Title of the table;",), (";".join(heading) + ";",)], "value string").coalesce(1)
    lines.write.mode("append").text(folder)
    return folder


@query
def price_files(spark, sf):
    """Prices to files and back, each file read once."""
    wide = inputs.prices_wide(spark, sf)
    names = ["metric", "region_level", "crop", "month", *inputs.years_of(wide)]
    rows, _ = whole_files.read_files(spark, _as_files(wide.select(*names), ["Kind", "Level", "Crop", "Month", *inputs.years_of(wide)]), names)
    return etl.clean_prices(rows, inputs.years_of(wide)).withColumn("year", F.col("year").cast("long"))


@query
def latin_files(spark, sf):
    """The production table as Latin-1 files: a letter of every crop's name is not ASCII."""
    wide = inputs.production_wide(spark, sf).withColumn("crop", F.concat(F.lit("Café "), F.trim("crop")))
    names = ["kind", "season", "crop", "location", *inputs.years_of(wide)]
    folder = _as_files(wide.select(*names), ["Kind", "Season", "Crop", "Level", *inputs.years_of(wide)], encoding="ISO-8859-1")
    rows, _ = whole_files.read_files(spark, folder, names)
    return etl.clean_production(rows, inputs.years_of(wide)).withColumn("year", F.col("year").cast("long"))


@query
def season_files(spark, sf):
    """Five columns per line: the largest value of every crop, place, season and metric."""
    base = inputs.season_rows(spark, sf).groupBy("metric", "season", "crop", "location").agg(F.max("value_2024").alias("value_2024"))
    folder = _as_files(base, ["Kind", "Season", "Crop", "Level", "2024"])
    rows, _ = whole_files.read_files(spark, folder, government.SEASON_PRODUCTION_FIELDS)
    rows = rows.withColumn("value_2024", F.col("value_2024").try_cast("double")).withColumn("line_no", F.struct("file", "line_no"))
    names = {"Area": "area_size", "Production": "total_yield"}
    return reshape.pivot_first(rows, ["season", "crop", "location"], "metric", "value_2024", "line_no", names)


@query
def refused_lines(spark, sf):
    """What the reader leaves out of the price files, and why."""
    wide = inputs.prices_wide(spark, sf)
    names = ["metric", "region_level", "crop", "month", *inputs.years_of(wide)]
    data, refused = whole_files.read_files(spark, _as_files(wide.select(*names), ["Kind", "Level", "Crop", "Month", *inputs.years_of(wide)]), names)
    kept = data.agg(F.lit("data").alias("reason"), F.count(F.lit(1)).alias("n"))
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(kept)


@query
def csv_round_trip(spark, sf):
    """Farm records to CSV and back through the typed reader."""
    names = ["record_id", "crop_name", "planting_date", "sale_date", "total_sales", "profit", "pest_indicator"]
    folder = scratch_path(spark, "records")
    tables.write_csv(farm_records(spark, sf, names).withColumn("pest_indicator", F.col("pest_indicator").cast("int")), folder)
    schema = StructType([FARM_RECORD[n] for n in names])
    return tables.read_farm_records(spark, folder, schema)


# --- data quality ---------------------------------------------------------------------


def _section(*sections: str) -> Query:
    def run(spark, sf):
        rows = farm_records(spark, sf, quality.section_columns(*sections))
        return _round(quality.rule_values(rows, *sections), 9, "value")

    return run


for _name in (
    "categories", "crop_season", "dates", "crop_duration", "planting_month", "ranges", "yield_sales", "prices", "finance",
    "resources", "weather", "pests", "levels", "sufficiency", "booleans", "profit",
):
    QUERIES[f"dq_{_name}"] = _section(_name)


@query
def dq_overview(spark, sf):
    return quality.overview(farm_records(spark, sf))


@query
def dq_record_id(spark, sf):
    return quality.record_ids(farm_records(spark, sf, ["record_id"]))


@query
def dq_required(spark, sf):
    return quality.required_columns(farm_records(spark, sf).drop("wind_speed", "profit"))


@query
def dq_median_profit(spark, sf):
    return _round(quality.median_profit(farm_records(spark, sf, ["profit"])), 9, "value")


@query
def dq_warnings(spark, sf):
    rows = cut_lineage(farm_records(spark, sf))
    return quality.warning_flags(quality.rule_values(rows).unionByName(quality.overview(rows)))


@query
def dq_report(spark, sf):
    rows = cut_lineage(farm_records(spark, sf))
    return _round(quality.report(rows), 6, "value")


# --- allocation -----------------------------------------------------------------------


@query
def softmax_shares(spark, sf):
    return _round(allocation.with_targets(inputs.farm_crops(spark, sf)), 6, "target").select("farm", "crop", "target")


def _bounded(spark, sf):
    split = allocation.allocate(inputs.farm_crops(spark, sf), fixed.MIN_SHARE, fixed.MAX_SHARE, places=None)
    return _round(split, 6, "allocation", "total_profit").select("farm", "crop", "allocation", "status", "total_profit")


@query
def allocate_bounded(spark, sf):
    return _bounded(spark, sf)


@query
def allocate_fallback(spark, sf):
    """Bounds that never add up: shares follow the profits."""
    split = allocation.allocate(inputs.farm_crops(spark, sf), 0.0, 0.01, places=None)
    return _round(split, 6, "allocation").select("farm", "crop", "allocation", "status", "total_profit")


@query
def allocate_smooth(spark, sf):
    split = allocation.allocate_smooth(inputs.farm_crops(spark, sf))
    return _round(split, 6, "target", "allocation").select("farm", "crop", "target", "allocation", "status")


def _limited(spark, sf):
    limits = {"water_limit": "area * 7D", "fertilizer_limit": "area * 6.5D"}
    farms = inputs.farm_crops(spark, sf).selectExpr("*", *[f"{v} as {k}" for k, v in limits.items()])
    return allocation.allocate_resources(farms)


@query
def allocate_resources(spark, sf):
    """Splits of all farms; amounts are shown where no limit costs anything, and the rest by its proof."""
    split = cut_lineage(_limited(spark, sf))
    free = F.when((F.col("water_price") == 0) & (F.col("fertilizer_price") == 0), F.round("allocation", 6))
    shown = split.select("farm", "crop", F.round("target", 6).alias("target"), free.alias("free_allocation"))
    return shown.join(allocation.proven(split), "farm")


@query
def resource_prices(spark, sf):
    """Amounts and prices of the farms' splits under their limits."""
    return _round(_limited(spark, sf), 4, "target", "allocation", "area_price", "water_price", "fertilizer_price")


@query
def allocation_report(spark, sf):
    crops = inputs.farm_crops(spark, sf)
    split = allocation.allocate_smooth(crops)
    needs = crops.select("farm", "crop", "water_per_area", "fert_per_area")
    report = allocation.allocation_report(split.join(needs, ["farm", "crop"]), places=6)
    return report.withColumn("place", F.col("place").cast("long"))


@query
def recommendations(spark, sf):
    crops = inputs.farm_crops(spark, sf)
    split = allocation.allocate(crops, fixed.MIN_SHARE, fixed.MAX_SHARE, places=None)
    return allocation.recommendations(allocation.allocation_report(split.withColumn("target", F.col("allocation")), places=6))


# --- requests -------------------------------------------------------------------------


def _balance(spark, sf):
    return enrich.latest_balance(inputs.crops_table(spark, sf), inputs.crop_supply(spark, sf), inputs.crop_demand(spark, sf))


@query
def latest_balance(spark, sf):
    return _balance(spark, sf)


@query
def latest_weather(spark, sf):
    return enrich.latest_weather(inputs.weather(spark, sf))


@query
def request_validation(spark, sf):
    checked = enrich.validated(inputs.farm_requests(spark, sf))
    return checked.select("request_id", F.array_join("reasons", "; ").alias("reasons"), F.array_join("warnings", "; ").alias("warnings"))


@query
def request_enrichment(spark, sf):
    requests = enrich.accepted(enrich.validated(inputs.farm_requests(spark, sf)))
    known = scoring.enriched(requests, _context(spark, sf, demand=False))
    picked = known.select(
        "request_id", "crop_name", "governorate", "farm_location", "region_type", "supply", "demand",
        F.col("demand_level_ord").cast("long").alias("demand_level_ord"), "sufficiency_status", "market_price",
        "area_size", "fertilizer_used", "water_used", "temperature", "humidity", "rainfall", "wind_speed",
    )
    return _round(picked, 6, "supply", "market_price", "area_size", "fertilizer_used", "water_used")


def _context(spark, sf, demand=True):
    rows = farm_records(spark, sf, ["crop_name", "market_price", *AREA_INPUTS, "supply_score", "demand_score"])
    if demand:
        baselines = stats.crop_baselines(rows.where("crop_name is not null"), more={"demand": F.avg("demand_score")})
    else:
        baselines = stats.crop_baselines(rows)
    return scoring.Context(baselines, _balance(spark, sf), inputs.weather(spark, sf), inputs.AS_OF)


# --- models ---------------------------------------------------------------------------


@query
def regression_metrics(spark, sf):
    rows = farm_records(spark, sf, ["quantity_sold", "actual_yield"]).selectExpr("actual_yield", "quantity_sold * 1.1D as prediction")
    return _round(ml.regression_metrics(rows, "actual_yield"), 6, "r2", "rmse", "mae")


@query
def classification_metrics(spark, sf):
    rows = farm_records(spark, sf, ["demand_level", "demand_score"])
    levels = rows.select("demand_level", s.level_from_score(F.col("demand_score"), fixed.DEMAND_CUTS).alias("prediction"))
    found = ml.classification_metrics(levels, "demand_level")
    return _round(found, 9, "accuracy", "f1", "weighted_precision", "weighted_recall")


@query
def fit_verdict(spark, sf):
    rows = farm_records(spark, sf, ["crop_name", "supply_score", "demand_score"]).groupBy("crop_name").agg(
        F.max("supply_score").alias("train_r2"), F.avg(F.expr("demand_score * 1.42D")).alias("test_r2")
    )
    return ml.with_verdict(rows, "train_r2", "test_r2").select("crop_name", "verdict")


@query
def hash_split(spark, sf):
    """Row counts and key sums of a repeatable split; plain arithmetic instead of a hash."""
    bucket = F.pmod(F.col("o_orderkey") * 7919 + 42, F.lit(100))
    train, test = ml.hash_split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], bucket=bucket)
    rows = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query
def leaderboard(spark, sf):
    """Regions as contestants: sorted by a metric, best first."""
    rows = farm_records(spark, sf, ["region_type", "actual_yield", "quantity_sold"])
    board = rows.groupBy(F.col("region_type").alias("model")).agg(F.round(F.corr("actual_yield", "quantity_sold"), 9).alias("r2"))
    return ml.best_of(board, "r2").withColumn("version", F.lit("best")).unionByName(board.withColumn("version", F.lit("all")))


def _record_columns(*specs):
    """Columns of the records that the models need, besides the key."""
    raw = [c for spec in specs for c in spec.raw_columns]
    names = [c for c in raw if c in FARM_RECORD.fieldNames()]
    return list(dict.fromkeys([*names, "demand_level"] if "demand_level_ord" in raw else names))


def _trainings(spark, sf, *specs):
    """``_training`` of several models; records of large tables are joined once for all of them.

    Small tables are joined for each: their rows are dealt by content, and fits sample by task.
    """
    if few_tasks(table(spark, sf, "lineitem")):
        return [_training(spark, sf, spec) for spec in specs]
    rows = cut_lineage(farm_records(spark, sf, ["record_id", *_record_columns(*specs)]), TASK_ROWS)
    return [ml.hash_split(ml.prepared(rows, spec, keep=["record_id"]), ["record_id"]) for spec in specs]


def _training(spark, sf, spec):
    rows = farm_records(spark, sf, ["record_id", *_record_columns(spec)])
    # fitting reads its rows many times: the joins behind them run once
    return ml.hash_split(cut_lineage(ml.prepared(rows, spec, keep=["record_id"]), TASK_ROWS), ["record_id"])


def _fitted(spark, sf, spec, estimator):
    train, _ = _training(spark, sf, spec)
    return ml.fitted(ml.pipeline(spec, estimator), train)


def _tree(spec, depth=5):
    return ml.rg.DecisionTreeRegressor(featuresCol="features", labelCol=spec.target, seed=ml.SEED, maxDepth=depth)


def _logistic():
    return ml.classifiers()["Logistic Regression"]


def _trained_board(spark, sf, spec, chosen):
    train, test = _training(spark, sf, spec)
    encoder, models = ml.fitted_all(spec, chosen, train)
    return ml.evaluated(models, spec, encoder.transform(test)).orderBy(F.desc("f1" if spec.classes else "r2"), "model")


@query
def profit_inputs(spark, sf):
    """The profit model's numeric inputs: levels as ordinals, dates as parts."""
    names = [c for c in ml.PROFIT.raw_columns if c in FARM_RECORD.fieldNames()]
    rows = farm_records(spark, sf, ["record_id", *names, "demand_level"])
    made = ml.prepared(rows, ml.PROFIT, keep=["record_id"])
    parts = [c for c in ml.PROFIT.numeric_columns if c.endswith(("_year", "_month", "_day"))]
    return made.withColumns({c: F.col(c).cast("long") for c in parts})


@query
def train_profit(spark, sf):
    zoo = ml.regressors("profit")
    return _trained_board(spark, sf, ml.PROFIT, {n: zoo[n] for n in ("Linear Regression", "Decision Tree")})


@query
def train_yield(spark, sf):
    forest = ml.rg.RandomForestRegressor(labelCol="actual_yield", seed=ml.SEED, numTrees=5, maxDepth=4)
    return _trained_board(spark, sf, ml.YIELD, {"Random Forest": forest})


@query
def train_price(spark, sf):
    boosted = ml.rg.GBTRegressor(labelCol="market_price", seed=ml.SEED, maxIter=3, maxDepth=3)
    return _trained_board(spark, sf, ml.PRICE, {"GBT": boosted})


@query
def train_demand(spark, sf):
    zoo = ml.classifiers()
    return _trained_board(spark, sf, ml.DEMAND, {n: zoo[n] for n in ("Logistic Regression", "Decision Tree")})


@query
def tune_profit(spark, sf):
    train, test = _training(spark, sf, ml.PROFIT)
    _, row = ml.tune_and_evaluate("Linear Regression Tuned", ml.regressors("profit")["Linear Regression"], ml.PROFIT, train, test, {"regParam": [0.0, 0.1]}, folds=2)
    return ml.with_verdict(ml.leaderboard(spark, [row], "test_r2"), "train_r2", "test_r2")


@query
def train_profit_rest(spark, sf):
    """The regressors that no other query fits."""
    zoo = ml.regressors("profit")
    return _trained_board(spark, sf, ml.PROFIT, {n: zoo[n] for n in ("Gaussian GLM", "Factorization Machine")})


@query
def train_demand_rest(spark, sf):
    """The classifiers that no other query fits."""
    zoo = ml.classifiers()
    return _trained_board(spark, sf, ml.DEMAND, {n: zoo[n] for n in ("Random Forest", "Naive Bayes", "OneVsRest")})


# Models of one or two numeric inputs: SQL repeats them, so everything around them can be compared.
LINES = {"by area": ["area_size"], "by water": ["water_used"], "by fertilizer": ["fertilizer_used"], "by rain": ["rainfall"]}


def _line(spark, sf, spec, columns, estimator=None):
    """Fitted on all records, saved and loaded again."""
    inputs_ = [c for c in dict.fromkeys([*columns, spec.target]) if c in FARM_RECORD.fieldNames()]
    rows = cut_lineage(farm_records(spark, sf, ["record_id", *inputs_]).where(F.col(spec.target).isNotNull()))
    path = scratch_path(spark, "model")
    models_.save_model(ml.line_model(spec, columns, estimator).fit(rows.selectExpr(*[f"cast({c} as double) as {c}" if c != spec.target or not spec.classes else c for c in inputs_])), path)
    return models_.load_model(path)


@query
def line_board(spark, sf):
    """Four lines for the yield, judged on held-out records in one scan, best first."""
    names = sorted({c for columns in LINES.values() for c in columns})
    rows = cut_lineage(farm_records(spark, sf, ["record_id", "actual_yield", *names]))
    train, test = ml.hash_split(rows, ["record_id"], bucket=F.pmod(F.col("record_id") * 7919 + 42, F.lit(100)))
    fitted = {name: ml.line_model(ml.YIELD, columns).fit(train) for name, columns in LINES.items()}
    board = ml.leaderboard(spark, ml.evaluated(fitted, ml.YIELD, test).toPandas().to_dict("records"), "r2")
    return _round(board, 6, "r2", "rmse", "mae")


@query
def version_comparison(spark, sf):
    """The best plain line next to the best one with a penalty."""
    names = sorted({c for columns in LINES.values() for c in columns})
    rows = cut_lineage(farm_records(spark, sf, ["record_id", "actual_yield", *names]))
    train, test = ml.hash_split(rows, ["record_id"], bucket=F.pmod(F.col("record_id") * 7919 + 42, F.lit(100)))

    def board(reg):
        line = ml.rg.LinearRegression(labelCol="actual_yield", solver="normal", regParam=reg)
        return ml.evaluated({name: ml.line_model(ml.YIELD, columns, line).fit(train) for name, columns in LINES.items()}, ml.YIELD, test)

    return _round(ml.compared(board(0.0), board(5.0), "r2", "r2"), 6, "score")


@query
def line_score_table(spark, sf):
    model = _line(spark, sf, ml.YIELD, ["area_size"])
    rows = scoring.score_table(farm_records(spark, sf, ["record_id", *ml.YIELD.raw_columns]), model, ml.YIELD)
    return _round(rows, 6, "prediction")


@query
def line_score_yield(spark, sf):
    model = _line(spark, sf, ml.YIELD, ["area_size"])
    scored = scoring.score_yield(_valid_requests(spark, sf), _context(spark, sf), model)
    return _round(scored, 6, "predicted_yield").select("request_id", "crop_name", "predicted_yield")


@query
def line_score_profit(spark, sf):
    """The predicted yield is the input of the profit line."""
    profit, yields = _line(spark, sf, ml.PROFIT, ["actual_yield"]), _line(spark, sf, ml.YIELD, ["area_size"])
    scored = scoring.score_profit(_valid_requests(spark, sf), _context(spark, sf), profit, yields)
    return _round(scored, 6, "actual_yield", "predicted_profit").select("request_id", "crop_name", "actual_yield", "predicted_profit")


@query
def line_score_price(spark, sf):
    model = _line(spark, sf, ml.PRICE, ["sale_gap_days"])
    scored = scoring.score_price(_valid_requests(spark, sf), _context(spark, sf), model)
    return _round(scored, 6, "predicted_price").select("request_id", "crop_name", "predicted_price")


@query
def bayes_score_demand(spark, sf):
    """Demand levels by counts: the label's text comes from what the pipeline learned."""
    model = _line(spark, sf, ml.DEMAND, ["sale_gap_days", "humidity"], ml.cl.NaiveBayes(featuresCol="features", labelCol="label"))
    scored = scoring.score_demand(_valid_requests(spark, sf), _context(spark, sf), model)
    return scored.select("request_id", "crop_name", "value")


@query
def line_optimise_requests(spark, sf):
    model = _line(spark, sf, ml.PROFIT, ["actual_yield"])
    requests = enrich.accepted(enrich.validated(inputs.crop_list_requests(spark, sf)))
    split = scoring.allocate_requests(requests, _context(spark, sf), model, places=None)
    shown = _round(split, 6, "allocation", "expected_total_profit", "profit_per_hectare", "area_hectares")
    return shown.withColumn("position", F.col("position").cast("long"))


@query
def line_plan_requests(spark, sf):
    """Candidate profits meet the median needs of their crops; one proof per request."""
    model = _line(spark, sf, ml.PROFIT, ["actual_yield"])
    requests = enrich.accepted(enrich.validated(inputs.crop_list_requests(spark, sf)))
    medians = stats.per_area_medians(farm_records(spark, sf, ["crop_name", *AREA_INPUTS]))
    split = cut_lineage(scoring.plan_requests(requests, _context(spark, sf), model, medians))
    needs = split.groupBy("farm").agg(*[F.round(F.sum(c), 6).alias(c) for c in ("profit", "water_per_area", "fert_per_area")])
    return allocation.proven(split).join(needs, "farm").withColumnRenamed("farm", "request_id")


@query
def crop_lookup(spark, sf):
    """Id and yield per donum of each request's crop."""
    requests = inputs.farm_requests(spark, sf).select("request_id", "crop_name")
    return _round(enrich.with_crop_table(requests, inputs.crops_table(spark, sf)), 6, "avg_yield_per_donum")


def _bucket():
    return F.pmod(F.col("record_id") * 7919 + 42, F.lit(100))


@query
def encoded_features(spark, sf):
    """Indexed, encoded, assembled and scaled: a number, and the share of each row's own region and season."""
    spec = ml.ModelSpec("actual_yield", (), ("region_type", "season"), ("area_size",))
    rows = cut_lineage(farm_records(spark, sf, ["record_id", *spec.raw_columns]))
    scale = ml.StandardScaler(inputCol="features", outputCol="scaled_features", withMean=True, withStd=True)
    made = ml.Pipeline(stages=[*ml.feature_stages(spec), scale]).fit(rows).transform(rows)
    regions = made.agg((F.max("region_type_idx") + 1).cast("int").alias("_regions"))
    found = joins.one_row(made.withColumn("_x", vector_to_array("scaled_features")), regions)
    return found.select(
        "record_id", F.col("region_type_idx").cast("long").alias("region_index"), F.col("season_idx").cast("long").alias("season_index"),
        F.round(F.col("_x")[0], 6).alias("area"), F.round(F.col("_x")[1 + F.col("region_type_idx").cast("int")], 6).alias("region"),
        F.round(F.col("_x")[1 + F.col("_regions") + F.col("season_idx").cast("int")], 6).alias("season"),
    )


@query
def unseen_labels(spark, sf):
    """Held-out records with a category that the training part, which lacks a region, never had."""
    rows = cut_lineage(farm_records(spark, sf, ["record_id", *ml.YIELD.raw_columns]))
    train, test = ml.hash_split(ml.prepared(rows, ml.YIELD, keep=["record_id"]), ["record_id"], bucket=_bucket())
    model = ml.Pipeline(stages=ml.feature_stages(ml.YIELD)).fit(train.where("region_type <> 'Desert'"))
    return ml.unseen_categories(test, model, ml.YIELD)


@query
def bayes_levels(spark, sf):
    """Records by true and predicted demand level."""
    columns = ["sale_gap_days", "humidity"]
    model = _line(spark, sf, ml.DEMAND, columns, ml.cl.NaiveBayes(featuresCol="features", labelCol="label"))
    rows = farm_records(spark, sf, ["demand_level", *columns]).where("demand_level is not null")
    scored = ml.readable_predictions(model.transform(rows.withColumns({c: F.col(c).cast("double") for c in columns})), model, "demand_level")
    return scored.groupBy("demand_level", "predicted_demand_level").agg(F.count(F.lit(1)).alias("n"))


@query
def bake_off_line(spark, sf):
    """Scaled features of one number and one indexed category, judged on held-out records."""
    rows = cut_lineage(farm_records(spark, sf, ["record_id", "region_type", "unit_price", "market_price"]))
    line = ml.rg.LinearRegression(featuresCol="scaled_features", labelCol="market_price", solver="normal")
    board = ml.bake_off({"line": line}, ["region_type"], ["unit_price"], "market_price", rows, bucket=_bucket())[2]
    return _round(board, 6, "r2", "rmse", "mae")


@query
def inventory_left(spark, sf):
    """What a tenth more sales would leave of the yield."""
    rows = farm_records(spark, sf, ["record_id", "actual_yield", "quantity_sold"])
    left = features.inventory_left(F.col("actual_yield"), F.col("quantity_sold") * 1.1)
    return rows.select("record_id", F.round(left, 6).alias("inventory_left"))


@query
def dropped_nulls(spark, sf):
    rows = farm_records(spark, sf, ["record_id", "customer_type", "total_sales", "area_size", "crop_name"])
    kept = checks.drop_columns(checks.drop_null_rows(rows, ["customer_type", "total_sales"]), ["customer_type"])
    return checks.cast_columns(kept, {"area_size": "bigint", "crop_name": "bigint"})


@query
def capped_sample(spark, sf):
    """The first records of a CSV file by profit: the limit is the operator."""
    folder = scratch_path(spark, "records")
    tables.write_csv(farm_records(spark, sf, ["record_id", "profit"]), folder)
    schema = StructType([FARM_RECORD["record_id"], FARM_RECORD["profit"]])
    return _round(tables.load_sample(spark, folder, 500, schema, order=["profit", "record_id"]), 6, "profit")


@query
def tune_linear(spark, sf):
    """The whole linear grid over three folds from one scan: profit by the value of the sales."""
    rows = farm_records(spark, sf, ["record_id", "quantity_sold", "profit"]).withColumn("fold", F.pmod("record_id", F.lit(3)))
    found = linear.search(linear.fold_states(rows, ["quantity_sold"], "profit", "fold"))
    return _round(found.board(spark), 9, "r2")


@query
def tune_profit_states(spark, sf):
    """The grid over all inputs of the profit model."""
    train, _ = _training(spark, sf, ml.PROFIT)
    stages = ml.Pipeline(stages=ml.feature_stages(ml.PROFIT)).fit(train)
    rows = linear.assembled(train.withColumn("fold", F.pmod(F.xxhash64("record_id"), F.lit(3))), stages, ["profit", "fold"])
    return linear.search(linear.fold_states(rows, "features", "profit", "fold")).board(spark)


@query
def feature_importances(spark, sf):
    train, _ = _training(spark, sf, ml.YIELD)
    model = ml.fitted(ml.pipeline(ml.YIELD, _tree(ml.YIELD)), train)
    return ml.feature_importances(model, model.transform(train))


@query
def bake_off(spark, sf):
    sales = etl.monthly_sales(_priced(spark, sf))
    models = {
        "LinearRegression": ml.rg.LinearRegression(featuresCol="scaled_features", labelCol="total_sales_jod"),
        "DecisionTreeRegressor": ml.rg.DecisionTreeRegressor(featuresCol="scaled_features", labelCol="total_sales_jod", maxBins=64, seed=ml.SEED),
    }
    names = ["crop_name", "month", "farm_location", "region_type"]
    numbers = ["area_size", "actual_yield_tons", "quantity_sold_kg", "unit_price_jod"]
    return ml.bake_off(models, names, numbers, "total_sales_jod", cut_lineage(sales))[2]


@query
def score_table(spark, sf):
    model = _fitted(spark, sf, ml.YIELD, _tree(ml.YIELD))
    return scoring.score_table(farm_records(spark, sf, ["record_id", *ml.YIELD.raw_columns]), model, ml.YIELD)


def _valid_requests(spark, sf):
    return enrich.valid(inputs.farm_requests(spark, sf))


@query
def score_yield(spark, sf):
    model = _fitted(spark, sf, ml.YIELD, _tree(ml.YIELD))
    return scoring.score_yield(_valid_requests(spark, sf), _context(spark, sf), model).select("request_id", "crop_name", "predicted_yield", "value")


@query
def score_profit(spark, sf):
    specs = (ml.PROFIT, ml.YIELD)
    profit, yields = (ml.fitted(ml.pipeline(spec, _tree(spec)), train) for spec, (train, _) in zip(specs, _trainings(spark, sf, *specs)))
    scored = scoring.score_profit(_valid_requests(spark, sf), _context(spark, sf), profit, yields)
    return scored.select("request_id", "crop_name", "actual_yield", "predicted_profit", "value")


@query
def score_demand(spark, sf):
    model = _fitted(spark, sf, ml.DEMAND, _logistic())
    return scoring.score_demand(_valid_requests(spark, sf), _context(spark, sf), model).select("request_id", "crop_name", "value")


@query
def score_price(spark, sf):
    model = _fitted(spark, sf, ml.PRICE, _tree(ml.PRICE))
    return scoring.score_price(_valid_requests(spark, sf), _context(spark, sf), model).select("request_id", "crop_name", "predicted_price", "value")


@query
def readable_predictions(spark, sf):
    """Predicted next to true demand levels, counted."""
    train, test = _training(spark, sf, ml.DEMAND)
    model = ml.fitted(ml.pipeline(ml.DEMAND, _logistic()), train)
    scored = ml.readable_predictions(model.transform(test), model, "demand_level")
    return scored.groupBy("demand_level", "predicted_demand_level").agg(F.count(F.lit(1)).alias("n"))


@query
def unseen_categories(spark, sf):
    train, test = _training(spark, sf, ml.YIELD)
    model = ml.fitted(ml.pipeline(ml.YIELD, _tree(ml.YIELD, 2)), train.where("crop_name <> 'Tomato'"))
    return ml.unseen_categories(test, model, ml.YIELD)


@query
def optimise_requests(spark, sf):
    model = _fitted(spark, sf, ml.PROFIT, _tree(ml.PROFIT))
    requests = enrich.accepted(enrich.validated(inputs.crop_list_requests(spark, sf)))
    return scoring.allocate_requests(requests, _context(spark, sf), model)


# --- streams --------------------------------------------------------------------------


@query
def stream_latest(spark, sf):
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return latest_of_stream(stream, "user_id", ["ts", "event_id"], "value")


@query
def stream_latest_levels(spark, sf):
    """The same in many small batches, merged into levels on the way."""
    folder = scratch_path(spark, "events")
    events = spark.read.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    events.repartition(9, "event_id").write.parquet(folder)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    return latest_of_stream(stream, "user_id", ["ts", "event_id"], "value", fanout=3)


def _request_files(spark, sf, folder):
    """Writes the requests to at least three files of about ``TASK_ROWS`` rows at most, and returns their number."""
    requests = inputs.farm_requests(spark, sf)
    files = max(3, -(-table(spark, sf, "lineitem").count() // TASK_ROWS))
    requests.repartition(files).write.parquet(folder)
    return files


@query
def line_stream_scores(spark, sf):
    """The yield line over requests that arrive as files: one streaming plan, equal to the batch."""
    folder = scratch_path(spark, "requests")
    files = _request_files(spark, sf, folder)
    model = _line(spark, sf, ml.YIELD, ["area_size"])
    context = _context(spark, sf).stored()
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(folder)
    scored, _ = scored_stream(stream, lambda rows: scoring.score_yield(rows, context, model))
    return _round(scored, 6, "predicted_yield").select("request_id", "crop_name", "predicted_yield")


@query
def stream_scores(spark, sf):
    """Requests arriving as files, validated and scored as one streaming plan."""
    folder = scratch_path(spark, "requests")
    requests = inputs.farm_requests(spark, sf)
    requests.write.parquet(folder)
    model = _fitted(spark, sf, ml.YIELD, _tree(ml.YIELD))
    context = _context(spark, sf).stored()
    stream = spark.readStream.schema(requests.schema).parquet(folder)
    scored, _ = scored_stream(stream, lambda batch: scoring.score_yield(batch, context, model))
    return scored.select("request_id", "crop_name", "predicted_yield")
