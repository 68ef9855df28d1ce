"""Inputs of the registered queries, derived from the given tables.

Statistics files, requests, operational tables and farms with candidate crops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import fixed_values as fixed
from furrow.plans.farm_view import crop_of_part, place_of, table
from furrow.session import spread

METRICS = {"R": "Farm-Gate Price", "A": "Central Market Prices ", "N": "Packs"}
AS_OF = "1998-01-01"

MONTH_NAME = "elt(month(l_shipdate), " + ", ".join(f"'{m}'" for m in fixed.MONTHS) + ")"
# thousands separator, as in the statistics files
GROUPED = "if(v >= 1000, concat(v div 1000, ',', lpad(cast(v % 1000 as string), 3, '0')), cast(v as string))"


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return spread(lines.join(part, lines.l_partkey == part.p_partkey).join(places, lines.l_suppkey == places.s_suppkey), lines)


def years(spark: SparkSession, sf_dir: str) -> list[str]:
    """All ship years of the table, in order."""
    found = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("string").alias("year")).where("year IS NOT NULL").distinct()
    return sorted(row["year"] for row in found.collect())


def years_of(wide: DataFrame) -> list[str]:
    """The year columns of a wide table."""
    return [c for c in wide.columns if c.isdigit()]


def production_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly area and production as untidy text; one place reports an estimate in place of production."""
    base = _shipped(spark, sf_dir).selectExpr(
        "concat(' ', p_brand) as crop", "n_name as location",
        "if(month(l_shipdate) between 5 and 10, ' Summer', 'Winter ') as season",
        "cast(year(l_shipdate) as string) as year", "l_quantity", "p_size",
    )
    sums = base.groupBy("season", "crop", "location", "year").agg(
        F.sum("l_quantity").cast("long").alias("grown"), F.sum("p_size").cast("long").alias("planted")
    )
    kinds = sums.selectExpr(
        "season", "crop", "location", "year",
        "inline(array(struct(' Area Harvested' as kind, planted as v), struct(if(location = 'NATION_3', 'Estimate', 'PRODUCTION tons ') as kind, grown as v)))",
    )
    text = kinds.selectExpr("kind", "season", "crop", "location", "year", f"if(v < 10, 'n/a', {GROUPED}) as t")
    return text.groupBy("kind", "season", "crop", "location").pivot("year", years(spark, sf_dir)).agg(F.max("t"))


def prices_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly prices per metric, region, crop and month; some crops go by another name, some are sold elsewhere."""
    metric = "case l_returnflag " + " ".join(f"when '{k}' then '{v}'" for k, v in METRICS.items()) + " end"
    base = _shipped(spark, sf_dir).selectExpr(
        f"{metric} as metric",
        "case when r_regionkey = 0 then 'Kingdom' when p_brand in ('Brand#3', 'Brand#7') then concat('Outer ', r_name) else r_name end as region_level",
        "if(p_brand = 'Brand#5', 'Old Brand#5', p_brand) as crop",
        f"{MONTH_NAME} as month", "cast(year(l_shipdate) as string) as year", "cast(floor(l_extendedprice) as bigint) as v",
    )
    best = base.groupBy("metric", "region_level", "crop", "month", "year").agg(F.max("v").alias("v"))
    text = best.selectExpr("metric", "region_level", "crop", "month", "year", f"{GROUPED} as t")
    return text.groupBy("metric", "region_level", "crop", "month").pivot("year", years(spark, sf_dir)).agg(F.max("t"))


def price_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place -> price region; some nations are listed by another name, so their places find none."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return both.selectExpr("if(n_nationkey < 20, lower(n_name), concat('old ', lower(n_name))) as location", "if(r_regionkey = 0, 'kingdom', lower(r_name)) as price_region")


def season_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many values per season, crop, place and metric; ``line_no`` orders them."""
    return _shipped(spark, sf_dir).selectExpr(
        "if(l_linenumber % 2 = 0, 'Area', 'Production') as metric",
        "case when month(l_shipdate) between 5 and 9 then 'Summer' when month(l_shipdate) = 10 then 'Autumn' else 'Winter' end as season",
        "p_brand as crop", "n_name as location", "if(l_tax = 0, null, l_quantity) as value_2024",
        "struct(l_orderkey, l_linenumber, l_extendedprice, l_quantity) as line_no",
    )


def season_price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farm-gate price of the last year per region, crop and month."""
    wide = prices_wide(spark, sf_dir).where(F.col("metric") == METRICS["R"])
    price = F.regexp_replace(F.col(years_of(wide)[-1]), ",", "").try_cast("double")
    return wide.select("region_level", "crop", "month", price.alias("price"))


def season_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return both.selectExpr("if(n_nationkey < 20, n_name, concat('Old ', n_name)) as location", "if(r_regionkey = 0, 'Kingdom', r_name) as price_region")


def farm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order line; some have no area, bad dates or an unknown place."""
    lines = table(spark, sf_dir, "lineitem")
    part = crop_of_part(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"))
    orders = table(spark, sf_dir, "orders")
    customer = place_of(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation"), "c_nationkey", "place")
    # the place first: requests without a valid one then skip the larger joins
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
    joined = lines.join(placed, lines.l_orderkey == placed.o_orderkey).join(part, lines.l_partkey == part.p_partkey)
    return spread(joined, lines).selectExpr(
        "l_orderkey * 10 + l_linenumber as request_id", "crop_name", "place as governorate", "place as market_location",
        "cast(p_size - 3 as double) as area_donums", "cast(to_date(o_orderdate) as string) as planting_date",
        "if(l_linenumber = 7, 'soon', cast(to_date(l_shipdate) as string)) as sale_date", "l_returnflag = 'R' as pest_indicator",
    )


def crop_list_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One allocation request per order, with candidate crops picked by its key."""
    names = ", ".join(f"'{row[1]}'" for row in fixed.crop_rows())
    n = len(fixed.crop_rows())
    picks = ", ".join(f"elt(cast((o_orderkey * {m} + {m}) % {n} as int) + 1, {names})" for m in (1, 2, 3, 5, 7, 11))
    orders = table(spark, sf_dir, "orders")
    customer = place_of(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation"), "c_nationkey", "governorate")
    # a request becomes several candidates, and the table behind it has few row groups
    return spread(orders.join(customer, orders.o_custkey == customer.c_custkey), orders).selectExpr(
        "o_orderkey as request_id", "cast(o_orderkey % 90 + 10 as double) as area_donums", "governorate",
        "cast(to_date(o_orderdate) as string) as planting_date", "cast(date_add(to_date(o_orderdate), 120) as string) as sale_date",
        f"concat_ws(' , ', {picks}) as crops_list",
    )


def crops_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operational crop table; one crop is in it by another name."""
    part = crop_of_part(table(spark, sf_dir, "part").select("p_brand", "p_size"))
    return part.groupBy("p_brand", "crop_name").agg(F.avg("p_size").alias("avg_yield_per_donum")).selectExpr(
        "cast(substring(p_brand, 7, 9) as bigint) as id", "if(p_brand = 'Brand#4', concat('Old ', crop_name), crop_name) as name_en", "avg_yield_per_donum"
    )


def _stock(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(part, lines.l_partkey == part.p_partkey).selectExpr(
        "cast(substring(p_brand, 7, 9) as bigint) as crop_id", "to_date(l_shipdate) as day", "l_quantity as tons"
    )


def crop_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stock(spark, sf_dir, "A").selectExpr("crop_id", "day as supply_date", "tons as total_estimated_tons")


def crop_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand rows; those of crop 6 go by another id."""
    return _stock(spark, sf_dir, "N").selectExpr("if(crop_id = 6, 1000006, crop_id) as crop_id", "day as demand_date", "tons as demand_tons")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations per place from the event table; one place is not a known one."""
    places = ", ".join("'" + row[0].replace("'", "\\'") + "'" for row in fixed.place_rows())
    return table(spark, sf_dir, "events").selectExpr(
        f"if(user_id % 12 = 5, 'Elsewhere', elt(cast(user_id % 12 as int) + 1, {places})) as governorate", "ts as observed_at", "value as temperature",
        "cast(event_id % 100 as double) as humidity", "cast(event_id % 7 as double) as rainfall", "cast(user_id % 30 as double) as wind_speed",
    )


def farm_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farms (customers) with candidate crops (brands), combined to one row each."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_tax", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    joined = lines.join(part, lines.l_partkey == part.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    return spread(joined, lines).groupBy(F.col("o_custkey").alias("farm"), F.col("p_brand").alias("crop")).agg(
        F.max(F.expr("p_retailprice / 10D")).alias("profit"),
        F.max(F.expr("1D + l_discount * 100D")).alias("water_per_area"),
        F.max(F.expr("1D + l_tax * 100D")).alias("fert_per_area"),
    ).selectExpr("farm", "crop", "cast(farm % 50 + 10 as double) as area", "profit", "water_per_area", "fert_per_area")
