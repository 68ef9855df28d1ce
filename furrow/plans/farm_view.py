"""Farm records derived from the order, part, customer and supplier tables.

Only the tables that the wanted columns need are joined: an inner join on a foreign
key cannot be dropped by the optimizer on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import fixed_values as fixed
from furrow.schemas import FARM_RECORD
from furrow.session import spread
from furrow.sources import lookups

# Brands with a higher number keep their brand as an unknown crop name.
MAPPED_BRANDS = 20

REGIONS = {"ECONOMY": "Desert", "LARGE": "Valley", "STANDARD": "Rural", "MEDIUM": "Urban"}
CUSTOMERS = {"BUILDING": "Trader", "MACHINERY": "Local Market", "FURNITURE": "Export", "AUTOMOBILE": "AUTOMOBILE"}
DEMAND_LEVELS = {"1-URGENT": "High", "2-HIGH": "High", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "Medium", "5-LOW": "Low"}
STATUSES = {"F": "Shortage", "O": "Surplus", "P": "Balanced"}



def _case(column: str, names: dict[str, str], other: str = "null") -> str:
    arms = " ".join(f"when '{key}' then '{value}'" for key, value in names.items())
    return f"case {column} {arms} else {other} end"


def _level(score: str, cuts: tuple[float, float]) -> str:
    return f"case when {score} < {cuts[0]}D then 'Low' when {score} >= {cuts[1]}D then 'High' else 'Medium' end"


# column -> (table it needs besides lineitem, Spark SQL expression)
COLUMNS = {
    "record_id": (None, "l_orderkey * 10 + l_linenumber"),
    "crop_name": ("part", "crop_name"),
    "planting_date": ("orders", "to_date(o_orderdate)"),
    "harvest_date": (None, "to_date(l_shipdate)"),
    "season": (
        None,
        "case when month(l_shipdate) in (11, 12, 1, 2) then 'Winter' when month(l_shipdate) in (3, 4, 5) then 'Spring'"
        " when month(l_shipdate) in (6, 7, 8) then 'Summer' else 'Fall' end",
    ),
    "area_size": ("part", "cast(p_size as double)"),
    "quantity_sold": (None, "l_quantity"),
    "inventory_remaining": (None, "cast(l_linenumber as double)"),
    "unit_price": ("part", "p_retailprice / 100D"),
    "total_sales": (None, "if(l_linestatus = 'F', l_extendedprice, null)"),
    "total_expenses": (None, "l_extendedprice * (1D - l_discount)"),
    "fertilizer_used": (None, "l_tax * 100D"),
    "water_used": (None, "l_discount * 1000D"),
    "actual_yield": (None, "l_quantity + l_linenumber"),
    "profit": (None, "l_extendedprice * l_discount - l_extendedprice * l_tax"),
    "sale_date": (None, "date_add(to_date(l_shipdate), l_linenumber)"),
    "sale_gap_days": (None, "l_linenumber"),
    "market_location": ("customer", "market_location"),
    "farm_location": ("supplier", "farm_location"),
    "region_type": ("part", _case("p_type", REGIONS, "p_type")),
    "distance_to_market": (None, "l_linenumber * 10D"),
    "transport_cost": (None, "l_extendedprice * l_tax"),
    "customer_type": ("customer", _case("c_mktsegment", CUSTOMERS)),
    "market_price": ("part", "p_retailprice / 100D * (l_tax * 3D + 0.9D)"),
    "temperature": (None, "l_quantity"),
    "humidity": (None, "l_discount * 1000D"),
    "rainfall": (None, "l_tax * 1000D"),
    "wind_speed": (None, "l_linenumber * 5D"),
    "pest_indicator": (None, "l_returnflag = 'R'"),
    "water_efficiency": (None, "try_divide(l_quantity + l_linenumber, l_discount * 1000D)"),
    "fertilizer_efficiency": (None, "try_divide(l_quantity + l_linenumber, l_tax * 100D)"),
    "demand_score": (None, "l_discount * 10D"),
    "demand_level": ("orders", _case("o_orderpriority", DEMAND_LEVELS, "o_orderpriority")),
    "supply_score": (None, "l_tax / 0.08D"),
    "supply_level": (None, _level("l_tax / 0.08D", fixed.SUPPLY_CUTS)),
    "sufficiency_status": ("orders", _case("o_orderstatus", STATUSES)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crop_of_part(part: DataFrame) -> DataFrame:
    """crop_name of each part: the crop with the brand's number, else the brand."""
    crops = lookups.crops(part.sparkSession).where(f"crop_no <= {MAPPED_BRANDS}").selectExpr("crop_no", "crop_name as _crop")
    numbered = part.selectExpr("*", "cast(substring(p_brand, 7, 9) as bigint) as crop_no")
    named = numbered.join(F.broadcast(crops), "crop_no", "left")
    return named.selectExpr(*part.columns, "coalesce(_crop, p_brand) as crop_name")


def place_of(df: DataFrame, nation: DataFrame, key: str, name: str) -> DataFrame:
    """Place name of a nation: one of the known places, else the nation's name."""
    known = ", ".join(f"'{place}'" for place in fixed.LOCATIONS)
    named = nation.selectExpr(f"n_nationkey as {key}", f"if(n_nationkey < {len(fixed.LOCATIONS)}, elt(n_nationkey + 1, {known}), n_name) as {name}")
    return df.join(named, key)


def farm_records(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The farm-record table, or the given columns of it."""
    wanted = list(columns or FARM_RECORD.fieldNames())
    needed = {COLUMNS[c][0] for c in wanted}
    rows = lines = table(spark, sf_dir, "lineitem")
    if "part" in needed:
        part = table(spark, sf_dir, "part")
        if "crop_name" in wanted:
            part = crop_of_part(part)
        rows = rows.join(part, rows.l_partkey == part.p_partkey)
    nation = table(spark, sf_dir, "nation")
    if needed & {"orders", "customer"}:
        orders = table(spark, sf_dir, "orders")
        if "customer" in needed:  # joined with the fewer rows of the orders, before the lines
            customer = table(spark, sf_dir, "customer")
            if "market_location" in wanted:
                customer = place_of(customer, nation, "c_nationkey", "market_location")
            orders = orders.join(customer, orders.o_custkey == customer.c_custkey)
        rows = rows.join(orders, rows.l_orderkey == orders.o_orderkey)
    if "supplier" in needed:
        supplier = place_of(table(spark, sf_dir, "supplier"), nation, "s_nationkey", "farm_location")
        rows = rows.join(supplier, rows.l_suppkey == supplier.s_suppkey)
    made = rows.selectExpr(*[f"{COLUMNS[c][1]} as {c}" for c in wanted])
    return spread(made, lines)
