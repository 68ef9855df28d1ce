"""DuckDB SQL for the registered queries, written against the given tables."""

from __future__ import annotations

from furrow import fixed_values as fixed


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    cells = [", ".join(_text(v) if isinstance(v, str) else repr(v) for v in row) for row in rows]
    return "(VALUES " + ", ".join(f"({c})" for c in cells) + ")"


def _list(values) -> str:
    return ", ".join(_text(v) for v in values)


PLACE = "CASE WHEN {k} < 12 THEN ([" + _list(fixed.LOCATIONS) + "])[{k} + 1] ELSE {n} END"
MONTH = "([" + _list(fixed.MONTHS) + "])[month(l_shipdate)]"
DAY = "CAST({} AS DATE)"

CROPS = f"""crop_facts(crop_no, crop_name, crop_category, crop_season, yield_lo, yield_hi, base_price, days_lo, days_hi) AS (
  SELECT * FROM {_values(fixed.crop_rows())})"""

FARM = CROPS + f""",
cropped AS (
  SELECT p.*, coalesce(c.crop_name, p.p_brand) AS crop_name, CAST(substr(p_brand, 7) AS BIGINT) AS brand_no
  FROM part p LEFT JOIN crop_facts c ON c.crop_no = CAST(substr(p_brand, 7) AS BIGINT) AND c.crop_no <= 20),
farm AS (
  SELECT l_orderkey * 10 + l_linenumber AS record_id, p.crop_name,
    CAST(o_orderdate AS DATE) AS planting_date, CAST(l_shipdate AS DATE) AS harvest_date,
    CASE WHEN month(l_shipdate) IN (11, 12, 1, 2) THEN 'Winter' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'Spring'
         WHEN month(l_shipdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
    CAST(p_size AS DOUBLE) AS area_size, l_quantity AS quantity_sold, CAST(l_linenumber AS DOUBLE) AS inventory_remaining,
    p_retailprice / 100e0 AS unit_price, CASE WHEN l_linestatus = 'F' THEN l_extendedprice END AS total_sales,
    l_extendedprice * (1e0 - l_discount) AS total_expenses, l_tax * 100e0 AS fertilizer_used, l_discount * 1000e0 AS water_used,
    l_quantity + l_linenumber AS actual_yield, l_extendedprice * l_discount - l_extendedprice * l_tax AS profit,
    CAST(l_shipdate AS DATE) + l_linenumber AS sale_date, l_linenumber AS sale_gap_days,
    {PLACE.format(k='nc.n_nationkey', n='nc.n_name')} AS market_location,
    {PLACE.format(k='ns.n_nationkey', n='ns.n_name')} AS farm_location,
    CASE p_type WHEN 'ECONOMY' THEN 'Desert' WHEN 'LARGE' THEN 'Valley' WHEN 'STANDARD' THEN 'Rural' WHEN 'MEDIUM' THEN 'Urban' ELSE p_type END AS region_type,
    l_linenumber * 10e0 AS distance_to_market, l_extendedprice * l_tax AS transport_cost,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Trader' WHEN 'MACHINERY' THEN 'Local Market' WHEN 'FURNITURE' THEN 'Export' WHEN 'AUTOMOBILE' THEN 'AUTOMOBILE' END AS customer_type,
    p_retailprice / 100e0 * (l_tax * 3e0 + 0.9e0) AS market_price,
    l_quantity AS temperature, l_discount * 1000e0 AS humidity, l_tax * 1000e0 AS rainfall, l_linenumber * 5e0 AS wind_speed,
    l_returnflag = 'R' AS pest_indicator,
    (l_quantity + l_linenumber) / nullif(l_discount * 1000e0, 0) AS water_efficiency,
    (l_quantity + l_linenumber) / nullif(l_tax * 100e0, 0) AS fertilizer_efficiency,
    l_discount * 10e0 AS demand_score,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '4-NOT SPECIFIED' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE o_orderpriority END AS demand_level,
    l_tax / 0.08e0 AS supply_score,
    CASE WHEN l_tax / 0.08e0 < 0.28e0 THEN 'Low' WHEN l_tax / 0.08e0 >= 0.5e0 THEN 'High' ELSE 'Medium' END AS supply_level,
    CASE o_orderstatus WHEN 'F' THEN 'Shortage' WHEN 'O' THEN 'Surplus' WHEN 'P' THEN 'Balanced' END AS sufficiency_status
  FROM lineitem JOIN cropped p ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN nation ns ON s_nationkey = ns.n_nationkey)"""


def _farm(select: str, *ctes: str) -> str:
    return "WITH " + ", ".join([FARM, *ctes]) + " " + select


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


MONEY = """money AS (
  SELECT *, quantity_sold * unit_price AS computed_revenue, coalesce(total_sales, quantity_sold * unit_price) AS revenue,
    total_expenses + transport_cost AS cost FROM farm)"""

ORACLES: dict[str, str] = {}

# --- finance --------------------------------------------------------------------------

ORACLES["summary_by_crop"] = _farm(
    """SELECT crop_name, round(sum(revenue), 4) AS revenue, round(sum(cost), 4) AS cost,
      round(sum(revenue - cost), 4) AS profit_calc, round(sum(quantity_sold), 4) AS quantity_sold,
      round(sum(revenue - cost) / nullif(sum(revenue), 0) * 100, 4) AS profit_margin_pct
    FROM money GROUP BY crop_name""", MONEY)
ORACLES["revenue_lines"] = _farm("SELECT record_id, computed_revenue, revenue FROM money", MONEY)
ORACLES["cost_profit_margin"] = _farm(
    """SELECT record_id, cost, revenue - cost AS profit_calc, profit - (revenue - cost) AS profit_diff,
      (revenue - cost) / nullif(revenue, 0) * 100 AS profit_margin_pct FROM money""", MONEY)
ORACLES["cost_without_transport"] = _farm(
    "SELECT record_id, total_expenses AS cost, revenue - total_expenses AS profit_calc FROM money", MONEY)
ORACLES["efficiency"] = _farm(
    """SELECT record_id, actual_yield / nullif(water_used, 0) AS water_efficiency,
      actual_yield / nullif(fertilizer_used, 0) AS fertilizer_efficiency FROM farm""")

# --- statistics -----------------------------------------------------------------------

ORACLES["crop_sums"] = _farm(
    """SELECT customer_type, round(coalesce(sum(total_sales), 0), 4) AS total_sales,
      round(coalesce(sum(total_expenses), 0), 4) AS total_expenses FROM farm WHERE customer_type IS NOT NULL GROUP BY 1""")
BASE = """base AS (
  SELECT crop_name, coalesce(avg(market_price), 0) AS market_price, coalesce(avg(actual_yield / nullif(area_size, 0)), 0) AS yield_per_ha,
    coalesce(avg(fertilizer_used / nullif(area_size, 0)), 0) AS fertilizer_per_ha,
    coalesce(avg(water_used / nullif(area_size, 0)), 0) AS water_per_ha, coalesce(avg(supply_score), 0) AS supply
  FROM farm GROUP BY crop_name)"""
ORACLES["crop_baselines"] = _farm(
    """SELECT crop_name, round(market_price, 6) AS market_price, round(yield_per_ha, 6) AS yield_per_ha,
      round(fertilizer_per_ha, 6) AS fertilizer_per_ha, round(water_per_ha, 6) AS water_per_ha, round(supply, 6) AS supply FROM base""", BASE)
ORACLES["crop_medians"] = _farm(
    """SELECT crop_name, round(quantile_cont(water_used / greatest(area_size, 1e-6), 0.5), 9) AS water_per_area,
      round(quantile_cont(fertilizer_used / greatest(area_size, 1e-6), 0.5), 9) AS fert_per_area
    FROM farm WHERE crop_name IN ('Tomato', 'Potato', 'Rice', 'Wheat', 'Onion', 'Brand#25') GROUP BY 1""")


def _extreme(key: str, value: str, label: str) -> str:
    means = f"(SELECT {key} AS k, avg({value}) AS m FROM farm WHERE {key} IS NOT NULL GROUP BY 1)"
    return (
        f"SELECT '{key}' AS attribute, '{label}' AS measure, (SELECT k FROM {means} WHERE m IS NOT NULL ORDER BY m, k LIMIT 1) AS lowest,"
        f" (SELECT k FROM {means} WHERE m IS NOT NULL ORDER BY m DESC, k LIMIT 1) AS highest"
    )


ORACLES["group_extremes"] = _farm(
    _union([_extreme("crop_name", "profit", "profit"), _extreme("region_type", "profit", "profit"), _extreme("customer_type", "total_sales", "sales")]))
GROUPED = ["crop_name", "demand_level", "supply_level", "sufficiency_status", "customer_type", "region_type"]
ORACLES["category_shares"] = _farm(_union(
    f"SELECT '{g}' AS attribute, {g} AS category, count(*) AS n, round(count(*) * 100e0 / (SELECT count({g}) FROM farm), 6) AS share_pct"
    f" FROM farm WHERE {g} IS NOT NULL GROUP BY {g}" for g in GROUPED))
ORACLES["label_counts"] = _farm("SELECT demand_level, count(*) AS n FROM farm GROUP BY 1")
LATEST = """SELECT user_id, value AS latest FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
ORACLES["latest_per_key"] = LATEST
ORACLES["stream_latest"] = LATEST
ORACLES["stream_latest_levels"] = LATEST
ORACLES["distinct_profile"] = _farm(_union(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM farm"
    for c in ("crop_name", "season", "region_type", "market_location", "customer_type", "demand_level")))
ORACLES["null_profile"] = _farm(_union(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM farm"
    for c in ("crop_name", "customer_type", "total_sales", "water_efficiency", "fertilizer_efficiency", "profit")))
ORACLES["conditional_means"] = _farm(
    """SELECT round(min(profit), 6) AS lowest, round(max(profit), 6) AS highest, round(avg(profit), 6) AS mean,
      round(avg(profit) FILTER (WHERE region_type = 'Desert'), 6) AS mean_desert,
      round(avg(profit) FILTER (WHERE region_type = 'Rural'), 6) AS mean_rural,
      round(avg(profit) FILTER (WHERE pest_indicator), 6) AS mean_pest FROM farm""")
ORACLES["true_shares"] = _farm(
    """SELECT round(count(*) FILTER (WHERE pest_indicator) * 1e0 / count(*) * 100, 4) AS pest_pct,
      round(count(*) FILTER (WHERE profit < 0) * 1e0 / count(*) * 100, 4) AS loss_pct,
      round(count(*) FILTER (WHERE total_sales IS NULL) * 1e0 / count(*) * 100, 4) AS no_sales_pct FROM farm""")


def _outlier(column: str) -> str:
    return f"""SELECT '{column}' AS column_name, count(*) FILTER (WHERE {column} < low OR {column} > high) AS outliers,
      round(any_value(a), 6) AS q0, round(any_value(b), 6) AS q1, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high
    FROM farm, (SELECT a, b, a - (b - a) * 1.5e0 AS low, b + (b - a) * 1.5e0 AS high FROM
      (SELECT quantile_cont({column}, 0.25) AS a, quantile_cont({column}, 0.75) AS b FROM farm))"""


ORACLES["iqr_outliers"] = _farm(_union(_outlier(c) for c in fixed.OUTLIER_COLUMNS))
ORACLES["correlations"] = _farm(_union(
    f"SELECT '{name}' AS pair, round(corr({a}, {b}), 9) AS corr FROM farm" for name, (a, b) in fixed.CORRELATION_PAIRS.items()))
ORACLES["correlation_matrix"] = _farm(
    "SELECT p.* FROM (SELECT unnest(["
    + ", ".join(
        f"{{'first': '{a}', 'second': '{b}', 'n': CAST(regr_count({a}, {b}) AS BIGINT), 'corr': round(CASE WHEN var_pop({a}) FILTER ({b} IS NOT NULL) > 0"
        f" AND var_pop({b}) FILTER ({a} IS NOT NULL) > 0 THEN corr({a}, {b}) END, 9)}}"
        for i, a in enumerate(fixed.CORRELATED) for b in fixed.CORRELATED[i + 1:])
    + "]) AS p FROM farm)")
ORACLES["relative_price"] = _farm(
    """SELECT record_id, crop_name, round(market_price / CASE WHEN m = 0 THEN 1 ELSE m END, 9) AS relative_price_index
    FROM (SELECT *, avg(market_price) OVER (PARTITION BY crop_name) AS m FROM farm)""")
ORACLES["minmax_scores"] = _farm(
    """SELECT record_id, round((area_size - a0) / (a1 - a0 + 1e-6), 9) AS area_scaled, round((profit - p0) / (p1 - p0 + 1e-6), 9) AS profit_scaled
    FROM farm, (SELECT min(area_size) AS a0, max(area_size) AS a1, min(profit) AS p0, max(profit) AS p1 FROM farm)""")
ORACLES["id_gaps"] = _farm(
    """SELECT count(*) = count(DISTINCT record_id) AS is_unique, count(*) - count(DISTINCT record_id) AS duplicates,
      min(record_id) AS lowest, max(record_id) AS highest, max(record_id) - min(record_id) + 1 - count(DISTINCT record_id) AS missing_in_range FROM farm""")
ORACLES["missing_ids"] = """SELECT r.id AS record_id FROM range((SELECT min(l_orderkey) FROM lineitem), (SELECT max(l_orderkey) + 1 FROM lineitem)) r(id)
  WHERE r.id NOT IN (SELECT l_orderkey FROM lineitem)"""
ORACLES["domain_violations"] = _farm(_union(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ({_list(v)})) AS invalid FROM farm"
    for c, v in (("region_type", fixed.REGION_TYPES), ("customer_type", fixed.CUSTOMER_TYPES), ("farm_location", fixed.LOCATIONS))))
ORACLES["first_rows"] = _farm("SELECT record_id, crop_name, profit FROM farm ORDER BY profit DESC, record_id, crop_name LIMIT 15")

# --- scalars and features -------------------------------------------------------------

ORACLES["date_parts"] = _farm("SELECT record_id, " + ", ".join(
    f"CAST({u}({p}_date) AS BIGINT) AS {p}_{u}" for p in ("planting", "sale") for u in ("year", "month", "day")) + " FROM farm")
ORACLES["ordinal_levels"] = _farm(
    """SELECT record_id, CAST(CASE demand_level WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS BIGINT) AS demand_ord,
      CASE WHEN demand_score < 0.36e0 THEN 'Low' WHEN demand_score < 0.64e0 THEN 'Medium' ELSE 'High' END AS demand_by_score,
      CASE WHEN supply_score < 0.28e0 THEN 'Low' WHEN supply_score < 0.5e0 THEN 'Medium' ELSE 'High' END AS supply_by_score FROM farm""")
ORACLES["demand_pressure"] = """SELECT l_orderkey,
    CAST(CASE WHEN d = 0 THEN 0 WHEN q / d > 1.2e0 THEN 0 WHEN q / d < 0.8e0 THEN 2 ELSE 1 END AS BIGINT) AS demand_level_ord,
    CASE WHEN d = 0 THEN 'Balanced' WHEN q > d * 1.2e0 THEN 'Surplus' WHEN q < d * 0.8e0 THEN 'Deficit' ELSE 'Balanced' END AS status
  FROM (SELECT l_orderkey, l_quantity AS q, l_discount * 500e0 AS d FROM lineitem)"""
RATIO = "round_even(least(greatest(supply_score * 0.92e0 + demand_score * 0.08e0, 0e0), 1e0) / {}, 6)"
ORACLES["sufficiency_score"] = _farm(
    f"""SELECT record_id, CASE WHEN r < 0.92e0 THEN 'Shortage' WHEN r <= 1.08e0 THEN 'Balanced' ELSE 'Surplus' END AS sufficiency_status
    FROM (SELECT record_id, {RATIO.format('greatest(demand_score, 1e-4)')} AS r FROM farm)""")
ORACLES["sale_gap"] = _farm("SELECT record_id, greatest(date_diff('day', DATE '1998-01-01', sale_date), 0) AS sale_gap_days FROM farm")
ORACLES["fallbacks"] = _farm(
    """SELECT record_id, round(CASE WHEN f.water_used = 0 THEN b.supply ELSE f.water_used END, 6) AS supply,
      round(b.market_price, 6) AS market_price, round(b.fertilizer_per_ha * (f.area_size * 0.1e0), 6) AS fertilizer_used,
      round(b.water_per_ha * (f.area_size * 0.1e0), 6) AS water_used FROM farm f JOIN base b USING (crop_name)""", BASE)
PICKS = (1, 2, 3, 5, 7, 11)
NAMES = "[" + _list(row[1] for row in fixed.crop_rows()) + "]"
ORACLES["split_crops"] = f"""WITH picks AS (SELECT o_orderkey, m, pos, ({NAMES})[(o_orderkey * m + m) % 35 + 1] AS crop_name
    FROM orders, (VALUES {', '.join(f'({m}, {i})' for i, m in enumerate(PICKS))}) v(m, pos)),
  firsts AS (SELECT o_orderkey, crop_name, min(pos) AS pos FROM picks GROUP BY 1, 2)
  SELECT o_orderkey AS request_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) - 1 AS position, crop_name FROM firsts"""
ORACLES["kind_clean"] = """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'area' WHEN p_size % 3 = 1 THEN 'production' ELSE lower(trim(p_name)) END AS kind,
    CASE WHEN p_size % 5 <> 0 THEN p_size * 1000 + 500.5e0 END AS number FROM part"""


def _factor(column: str, weights: dict, other: float = 1.0) -> str:
    arms = " ".join(f"WHEN {_text(k)} THEN {v}e0" for k, v in weights.items())
    return f"(CASE {column} {arms} ELSE {other}e0 END)"


POTENTIAL = f"(area_size * 2e0 * {_factor('region_type', fixed.REGION_YIELD)} * CASE WHEN rainfall >= 8 AND rainfall <= 25 THEN 1.08e0 ELSE 1e0 END)"
ORACLES["yield_price_factors"] = _farm(
    f"""SELECT record_id, round(least(greatest(0.02e0 + CASE WHEN humidity > 60 THEN 0.05e0 ELSE 0 END + CASE WHEN rainfall > 25 THEN 0.04e0 ELSE 0 END
        + CASE WHEN temperature > 34 THEN 0.03e0 ELSE 0 END, 0.02e0), 0.2e0), 9) AS pest_probability,
      round({POTENTIAL}, 9) AS potential_yield,
      round(greatest({POTENTIAL} * CASE WHEN temperature > 37 THEN 0.85e0 ELSE 1e0 END * CASE WHEN wind_speed > 22 THEN 0.92e0 ELSE 1e0 END
        * CASE WHEN pest_indicator THEN 0.8e0 ELSE 1e0 END, 0.05e0), 9) AS actual_yield,
      round(area_size * 10e0 * {_factor('region_type', fixed.REGION_WATER, 0.9)}, 9) AS water_used,
      round(least(unit_price / 10 * {_factor('market_location', fixed.MARKET_PRICE_FACTOR)} * {_factor('customer_type', fixed.CUSTOMER_PRICE_FACTOR)}
        * 1.1e0 * 1.52e0, 6.5e0), 9) AS unit_price FROM farm""")
ORACLES["expense_parts"] = _farm(
    """SELECT record_id, round(e, 6) AS total_expenses, round(s - e, 6) AS profit, planting_date + days_lo AS harvest_date,
      planting_date + days_lo + 5 AS sale_date, crop_category FROM (
      SELECT record_id, crop_category, planting_date, CAST(days_lo AS INTEGER) AS days_lo, quantity_sold * unit_price AS s,
        area_size * 1e0 + water_used * 0.01e0 + fertilizer_used * 0.2e0 + area_size * 0.5e0 + area_size * 0.1e0 + quantity_sold * 0.01e0 + transport_cost AS e
      FROM farm LEFT JOIN crop_facts USING (crop_name))""")
ORACLES["demand_score"] = _farm(
    """SELECT record_id, round(rel, 8) AS relative_price_index,
      round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 1e-6), 8) AS demand_score FROM scored""",
    f"""terms AS (SELECT *, market_price / avg(market_price) OVER (PARTITION BY crop_name) AS rel FROM farm LEFT JOIN
      (SELECT crop_name, crop_season FROM crop_facts) USING (crop_name)),
    scored AS (SELECT record_id, rel, 0.30e0 * least(quantity_sold / greatest(actual_yield, 1e-6), 1e0) + 0.18e0 * rel
      + 0.16e0 * (1 - least((sale_gap_days - 1) / 30e0, 1e0)) + 0.14e0 * (1 - least(inventory_remaining / greatest(actual_yield, 1e-6), 1e0))
      + 0.12e0 * {_factor('customer_type', fixed.CUSTOMER_DEMAND)} + 0.07e0 * {_factor('market_location', fixed.MARKET_DEMAND)}
      + 0.03e0 * {_factor('crop_season', fixed.SEASON_DEMAND)} AS raw FROM terms)""")


def _norm(x: str) -> str:
    return f"(({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER () + 1e-6))"


ORACLES["supply_score"] = _farm(
    f"SELECT record_id, penalty AS climate_penalty, round({_norm('raw')}, 8) AS supply_score FROM scored",
    """eff AS (SELECT record_id, area_size, actual_yield, actual_yield / greatest(area_size, 1e-6) AS ya, actual_yield / greatest(water_used, 1e-6) AS we,
      actual_yield / greatest(fertilizer_used, 1e-6) AS fe, CAST(CAST(temperature > 37 AS INT) + CAST(wind_speed > 22 AS INT)
        + CAST(rainfall > 25 AS INT) + CAST(pest_indicator AS INT) AS BIGINT) AS penalty FROM farm)""",
    f"""scored AS (SELECT record_id, penalty, 0.24e0 * {_norm('ya')} + 0.16e0 * {_norm('area_size')} + 0.22e0 * {_norm('we')} + 0.20e0 * {_norm('fe')}
      + 0.10e0 * {_norm('actual_yield')} + 0.08e0 * (1 - penalty / greatest(max(penalty) OVER (), 1)) AS raw FROM eff)""")

# --- statistics files -----------------------------------------------------------------

SHIPPED = f"""shipped AS (
  SELECT l.*, p_brand, p_size, n_name, n_nationkey, r_name, r_regionkey, year(l_shipdate) AS yr, {MONTH} AS mon
  FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PRODUCTION = SHIPPED + f""",
halves AS (SELECT *, CASE WHEN month(l_shipdate) BETWEEN 5 AND 10 THEN 'summer' ELSE 'winter' END AS season FROM shipped),
sums AS (SELECT season, lower(p_brand) AS crop, lower(n_name) AS location, yr, sum(p_size) AS planted, sum(l_quantity) AS grown FROM halves GROUP BY ALL),
kinds AS (
  SELECT 'area' AS kind, season, crop, location, yr, CASE WHEN planted < 10 THEN 0 ELSE planted END AS v FROM sums UNION ALL
  SELECT CASE WHEN location = 'nation_3' THEN 'estimate' ELSE 'production' END, season, crop, location, yr, CASE WHEN grown < 10 THEN 0 ELSE grown END FROM sums),
melted AS (
  SELECT k.kind, k.season, k.crop, k.location, CAST(y.yr AS BIGINT) AS year, CAST(coalesce(v, 0) AS DOUBLE) AS value
  FROM (SELECT DISTINCT kind, season, crop, location FROM kinds) k CROSS JOIN (SELECT DISTINCT yr FROM shipped) y
  LEFT JOIN kinds USING (kind, season, crop, location, yr)),
production AS (
  SELECT crop, location, season, year, sum(value) FILTER (WHERE kind = 'area') AS area_size, sum(value) FILTER (WHERE kind = 'production') AS total_yield
  FROM melted GROUP BY ALL)"""
MONTHS = "months AS (SELECT unnest([" + _list(fixed.MONTHS) + "]) AS month, unnest(range(1, 13)) AS month_no)"
PRICES = f"""price_cells AS (
  SELECT l_returnflag AS flag, CASE WHEN r_regionkey = 0 THEN 'kingdom' WHEN p_brand IN ('Brand#3', 'Brand#7') THEN 'outer ' || lower(r_name) ELSE lower(r_name) END AS region,
    CASE WHEN p_brand = 'Brand#5' THEN 'old ' ELSE '' END || lower(p_brand) AS crop, mon AS month, yr, max(floor(l_extendedprice)) AS v
  FROM shipped GROUP BY ALL),
all_prices AS (
  SELECT k.flag, k.region, k.crop, k.month, CAST(y.yr AS BIGINT) AS year, CAST(coalesce(v, 0) AS DOUBLE) AS price
  FROM (SELECT DISTINCT flag, region, crop, month FROM price_cells) k CROSS JOIN (SELECT DISTINCT yr FROM shipped) y
  LEFT JOIN price_cells USING (flag, region, crop, month, yr)),
prices AS (SELECT * FROM all_prices WHERE flag = 'R')"""
REGIONS = """regions AS (
  SELECT lower(n_name) AS location, CASE WHEN r_regionkey = 0 THEN 'kingdom' ELSE lower(r_name) END AS price_region
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20)"""


def _priced(prices: str) -> str:
    return f"""priced AS (
  SELECT p.crop, p.location, p.season, p.year, m.month, m.month_no, p.area_size, p.total_yield, coalesce(r.price_region, 'kingdom') AS price_region,
    a.price, k.price AS price_kingdom, coalesce(a.price, k.price, 0) AS final_price
  FROM production p CROSS JOIN months m LEFT JOIN regions r USING (location)
  LEFT JOIN {prices} a ON a.region = coalesce(r.price_region, 'kingdom') AND a.crop = p.crop AND a.month = m.month AND a.year = p.year
  LEFT JOIN {prices} k ON k.region = 'kingdom' AND k.crop = p.crop AND k.month = m.month AND k.year = p.year)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


ORACLES["melt_years"] = _with(PRODUCTION) + "SELECT kind, season, crop, location, year, value FROM melted"
ORACLES["pivot_kinds"] = _with(PRODUCTION) + "SELECT * FROM production"
ORACLES["government_files"] = ORACLES["pivot_kinds"]
SEASONED = f"""raw AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'Area' ELSE 'Production' END AS metric,
    CASE WHEN month(l_shipdate) BETWEEN 5 AND 9 THEN 'Summer' WHEN month(l_shipdate) = 10 THEN 'Autumn' ELSE 'Winter' END AS season,
    p_brand AS crop, n_name AS location, l_quantity AS v, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS no
  FROM shipped WHERE l_tax <> 0),
seasons AS (SELECT season, crop, location, arg_min(v, no) FILTER (WHERE metric = 'Area') AS area_size,
    arg_min(v, no) FILTER (WHERE metric = 'Production') AS total_yield FROM raw GROUP BY ALL),
halfyears(season, month) AS ({_values((s, m) for s, ms in fixed.HALF_YEAR_MONTHS.items() for m in ms)[1:-1]}),
spread AS (SELECT s.*, h.month, total_yield / 6 AS monthly FROM seasons s LEFT JOIN halfyears h USING (season))"""
ORACLES["pivot_first"] = _with(SHIPPED, SEASONED) + "SELECT * FROM seasons"
ORACLES["season_explode"] = _with(SHIPPED, SEASONED) + "SELECT season, crop, location, month, round(monthly, 9) AS monthly_yield_est FROM spread"
ORACLES["monthly_expand"] = _with(PRODUCTION, MONTHS) + (
    "SELECT crop, location, season, year, month, round(total_yield / 12, 9) AS monthly_yield_est FROM production, months")
ORACLES["price_fallback_join"] = _with(PRODUCTION, MONTHS, PRICES, REGIONS, _priced("prices")) + (
    "SELECT crop, location, season, year, month, price_region, price, price_kingdom, final_price FROM priced")
ORACLES["price_files"] = _with(PRODUCTION, PRICES) + "SELECT region AS region_level, crop, month, year, price FROM prices"
ORACLES["refused_lines"] = _with(PRODUCTION, PRICES) + """SELECT 'data' AS reason, count(*) AS n FROM (SELECT DISTINCT flag, region, crop, month FROM price_cells)
  UNION ALL SELECT 'before the table', 1 UNION ALL SELECT 'heading', 1"""
ORACLES["latin_files"] = _with(PRODUCTION) + "SELECT * REPLACE ('café ' || crop AS crop) FROM production"
ORACLES["season_files"] = _with(SHIPPED, SEASONED) + """SELECT season, crop, location, max(v) FILTER (WHERE metric = 'Area') AS area_size,
    max(v) FILTER (WHERE metric = 'Production') AS total_yield FROM raw GROUP BY ALL"""
ORACLES["price_fan_out"] = _with(
    PRODUCTION, MONTHS, PRICES, REGIONS, "any_price AS (SELECT * FROM all_prices WHERE flag IN ('R', 'A'))", _priced("any_price")
) + "SELECT crop, year, count(*) AS n, sum(final_price) AS price_sum FROM priced GROUP BY ALL"
ORACLES["metric_filter"] = _with(SHIPPED, PRICES) + """, cells AS (SELECT DISTINCT flag, region, name AS crop, month FROM price_cells
    JOIN (SELECT DISTINCT CASE WHEN p_brand = 'Brand#5' THEN 'Old ' ELSE '' END || p_brand AS name FROM part) ON lower(name) = crop),
  named AS (SELECT *, CASE flag WHEN 'R' THEN 'Farm-Gate Price' WHEN 'A' THEN 'Central Market Prices ' ELSE 'Packs' END AS metric FROM cells)
  SELECT 'any price' AS rule, metric, crop, count(*) AS n FROM named WHERE flag <> 'N' GROUP BY ALL UNION ALL
  SELECT 'one metric', metric, crop, count(*) FROM named WHERE flag = 'R' GROUP BY ALL UNION ALL
  SELECT 'no price', metric, crop, count(*) FROM named WHERE flag = 'N' GROUP BY ALL"""
ORACLES["etl_output"] = _with(PRODUCTION, MONTHS, PRICES, REGIONS, _priced("prices")) + """
  SELECT row_number() OVER (ORDER BY crop, location, season, year, month_no) AS record_id, crop AS crop_name, year, month,
    location AS farm_location, price_region AS region_type, nullif(area_size, 0) AS area_size, nullif(total_yield, 0) AS actual_yield_tons,
    round(nullif(total_yield / 12 * 1000, 0), 9) AS quantity_sold_kg, round(nullif(final_price / 1000, 0), 9) AS unit_price_jod,
    round(nullif(total_yield / 12 * 1000 * (final_price / 1000), 0), 6) AS total_sales_jod FROM priced"""
ORACLES["season_output"] = _with(SHIPPED, SEASONED, f"""price_cells AS (
    SELECT CASE WHEN r_regionkey = 0 THEN 'Kingdom' ELSE r_name END AS region, p_brand AS crop, mon AS month, max(floor(l_extendedprice)) FILTER (WHERE yr = (SELECT max(yr) FROM shipped)) AS price
    FROM shipped WHERE l_returnflag = 'R' AND p_brand <> 'Brand#5' AND NOT (r_regionkey <> 0 AND p_brand IN ('Brand#3', 'Brand#7')) GROUP BY ALL)""",
    """regions AS (SELECT n_name AS location, CASE WHEN r_regionkey = 0 THEN 'Kingdom' ELSE r_name END AS price_region
    FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20)""",
    """priced AS (SELECT s.*, coalesce(r.price_region, 'Kingdom') AS price_region, coalesce(a.price, k.price) / 1000e0 AS unit, monthly * 1000 AS kilos
    FROM spread s LEFT JOIN regions r USING (location)
    LEFT JOIN price_cells a ON a.region = coalesce(r.price_region, 'Kingdom') AND a.crop = s.crop AND a.month IS NOT DISTINCT FROM s.month
    LEFT JOIN price_cells k ON k.region = 'Kingdom' AND k.crop = s.crop AND k.month IS NOT DISTINCT FROM s.month)""",
    "month_names AS (SELECT unnest([" + _list(fixed.MONTHS) + "]) AS month, unnest(range(1, 13)) AS month_no)") + """
  SELECT row_number() OVER (ORDER BY season, crop, location, month_no NULLS FIRST, unit NULLS FIRST) AS record_id, crop AS crop_name, season, month,
    location AS farm_location, price_region AS region_type, area_size, round(kilos, 6) AS quantity_sold, round(unit, 6) AS unit_price,
    round(kilos * unit, 6) AS total_sales, round(unit * 1.15e0, 6) AS market_price, CAST(NULL AS VARCHAR) AS expense_type
  FROM priced LEFT JOIN month_names USING (month)"""
ORACLES["csv_round_trip"] = _farm("SELECT record_id, crop_name, planting_date, sale_date, total_sales, profit, pest_indicator FROM farm")

# --- data quality ---------------------------------------------------------------------

RECORDS = "records AS (SELECT * FROM farm LEFT JOIN crop_facts USING (crop_name))"


def _rules(section: str, rules: dict[str, str]) -> str:
    """One scan in a CTE, then a row per rule."""
    names = list(rules)
    measured = "measured AS (SELECT " + ", ".join(f"{sql} AS {n}" for n, sql in rules.items()) + " FROM records)"
    rows = _union(f"SELECT '{section}' AS section, '{n}' AS rule, round(CAST({n} AS DOUBLE), 9) AS value FROM measured" for n in names)
    return _farm(rows, RECORDS, measured)


def _n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _mean(value: str, condition: str) -> str:
    return f"avg({value}) FILTER (WHERE {condition})"


SOLD, PER_AREA = "(quantity_sold / (actual_yield + 1e-6))", "(actual_yield / (area_size + 1e-6))"
MARKUP, MARGIN, PER_KM = "(market_price / (unit_price + 1e-6))", "(profit / (total_sales + 1e-6))", "(transport_cost / (distance_to_market + 1e-6))"
DAYS, KEPT = "(harvest_date - planting_date)", "(sale_date - harvest_date)"
RISK = "(humidity > 60 OR rainfall > 25 OR temperature > 34)"
SCORE_RATIO = RATIO.format("(demand_score + 1e-4)")
SHORT = f"(sufficiency_status = 'Shortage' AND {SCORE_RATIO} >= 0.92e0 + 1e-3)"
BALANCED = f"(sufficiency_status = 'Balanced' AND ({SCORE_RATIO} < 0.92e0 - 1e-3 OR {SCORE_RATIO} > 1.08e0 + 1e-3))"
SURPLUS = f"(sufficiency_status = 'Surplus' AND {SCORE_RATIO} <= 1.08e0 - 1e-3)"
DOMAINS = {
    "crop_name": [row[1] for row in fixed.crop_rows()], "season": fixed.SEASONS, "market_location": fixed.LOCATIONS,
    "farm_location": fixed.LOCATIONS, "region_type": fixed.REGION_TYPES, "customer_type": fixed.CUSTOMER_TYPES,
    "demand_level": fixed.LEVELS, "supply_level": fixed.LEVELS, "sufficiency_status": fixed.SUFFICIENCY,
}
BOUNDS = {"temperature": (5, 50), "humidity": (10, 100), "rainfall": (0, 150), "wind_speed": (0, 35), "demand_score": (0, 1), "supply_score": (0, 1)}


def _level_mean(side: str, level: str) -> str:
    return _mean(f"{side}_score", f"{side}_level = '{level}'")


def _order_flag(side: str) -> str:
    low, mid, high = (_level_mean(side, level) for level in fixed.LEVELS)
    return f"CASE WHEN {low} < {mid} AND {mid} < {high} THEN 0 ELSE 1 END"


DESERT, RURAL = "region_type = 'Desert'", "region_type = 'Rural'"
RULES: dict[str, dict[str, str]] = {
    "categories": {f"invalid_{c}_count": _n(f"{c} IS NULL OR {c} NOT IN ({_list(v)})") for c, v in DOMAINS.items()},
    "crop_season": {"crop_season_mismatch_count": _n("crop_season IS NULL OR season IS NULL OR season <> crop_season")},
    "dates": {
        "bad_date_order_count": _n("planting_date >= harvest_date OR harvest_date >= sale_date"),
        "crop_duration_too_short_count": _n(f"{DAYS} < 30"),
        "crop_duration_too_long_count": _n(f"{DAYS} > 250"),
        "sale_gap_too_short_count": _n(f"{KEPT} < 1"),
        "sale_gap_too_long_count": _n(f"{KEPT} > 45"),
    },
    "crop_duration": {
        "crop_duration_below_crop_min_count": _n(f"{DAYS} < days_lo"),
        "crop_duration_above_crop_max_count": _n(f"{DAYS} > days_hi"),
    },
    "planting_month": {
        "planting_month_out_of_season_count": _n(
            "NOT CASE season WHEN 'Winter' THEN month(planting_date) IN (11, 12, 1, 2) WHEN 'Spring' THEN month(planting_date) IN (3, 4, 5)"
            " WHEN 'Summer' THEN month(planting_date) IN (6, 7, 8) WHEN 'Fall' THEN month(planting_date) IN (9, 10) ELSE false END")
    },
    "ranges": {
        **{f"{c}_negative_count": _n(f"{c} < 0") for c in fixed.NON_NEGATIVE_COLUMNS},
        "area_size_too_large_count": _n("area_size > 120"),
        **{f"{c}_out_of_range_count": _n(f"{c} < {lo} OR {c} > {hi}") for c, (lo, hi) in BOUNDS.items()},
    },
    "yield_sales": {
        "quantity_sold_gt_actual_yield_count": _n("quantity_sold > actual_yield + 1e-6"),
        "quantity_sold_equal_zero_count": _n("quantity_sold <= 0"),
        "actual_yield_equal_zero_count": _n("actual_yield <= 0"),
        "sales_ratio_gt_1_count": _n(f"{SOLD} > 1"),
        "sales_ratio_lt_0_75_count": _n(f"{SOLD} < 0.75e0"),
        "sales_ratio_gt_0_999_count": _n(f"{SOLD} > 0.999e0"),
        "yield_per_area_too_low_count": _n(f"{PER_AREA} < yield_lo * 0.5e0"),
        "yield_per_area_too_high_count": _n(f"{PER_AREA} > yield_hi * 2.8e0"),
        "yield_per_area_zero_count": _n(f"{PER_AREA} <= 0"),
    },
    "prices": {
        "unit_price_non_positive_count": _n("unit_price <= 0"),
        "market_price_non_positive_count": _n("market_price <= 0"),
        "unit_price_too_low_vs_base_count": _n("unit_price < base_price * 0.6e0"),
        "unit_price_too_high_vs_base_count": _n("unit_price > base_price * 4e0"),
        "market_price_too_far_from_unit_price_count": _n(f"{MARKUP} < 0.9e0 OR {MARKUP} > 1.15e0"),
        "unit_price_gt_market_price_count": _n("unit_price > market_price * 1.05e0"),
    },
    "finance": {
        "profit_formula_mismatch_count": _n("abs(profit - round_even(total_sales - total_expenses, 2)) > 1"),
        "total_sales_formula_mismatch_count": _n("abs(total_sales - round_even(quantity_sold * unit_price, 2)) > 1"),
        "profit_margin_gt_300pct_count": _n(f"{MARGIN} > 3"),
        "profit_margin_lt_minus90pct_count": _n(f"{MARGIN} < -0.9e0"),
        "expenses_gt_5x_sales_count": _n("total_expenses / (total_sales + 1e-6) > 5"),
    },
    "resources": {
        "fertilizer_per_area_too_low_count": _n("fertilizer_used / (area_size + 1e-6) < 0.15e0"),
        "fertilizer_per_area_too_high_count": _n("fertilizer_used / (area_size + 1e-6) > 1"),
        "water_per_area_too_low_count": _n("water_used / (area_size + 1e-6) < 5"),
        "water_per_area_too_high_count": _n("water_used / (area_size + 1e-6) > 25"),
        "transport_cost_zero_with_positive_distance_count": _n("distance_to_market > 0 AND transport_cost <= 0"),
        "transport_per_km_too_low_count": _n(f"{PER_KM} < 0.005e0"),
        "transport_per_km_too_high_count": _n(f"{PER_KM} > 0.2e0"),
        "desert_avg_water_used": _mean("water_used", DESERT),
        "rural_avg_water_used": _mean("water_used", RURAL),
        "desert_water_not_higher_than_rural_flag": f"{_mean('water_used', DESERT)} <= {_mean('water_used', RURAL)}",
    },
    "weather": {
        "average_desert_temperature": _mean("temperature", DESERT),
        "average_rural_temperature": _mean("temperature", RURAL),
        "average_desert_rainfall": _mean("rainfall", DESERT),
        "average_rural_rainfall": _mean("rainfall", RURAL),
        "desert_not_hotter_than_rural_flag": f"{_mean('temperature', DESERT)} <= {_mean('temperature', RURAL)}",
        "desert_not_drier_than_rural_flag": f"{_mean('rainfall', DESERT)} >= {_mean('rainfall', RURAL)}",
    },
    "pests": {
        "pest_rate_high_risk": _mean("CAST(pest_indicator AS DOUBLE)", RISK),
        "pest_rate_low_risk": _mean("CAST(pest_indicator AS DOUBLE)", f"NOT {RISK}"),
        "pest_not_higher_in_high_risk_flag": f"{_mean('CAST(pest_indicator AS DOUBLE)', RISK)} <= {_mean('CAST(pest_indicator AS DOUBLE)', 'NOT ' + RISK)}",
    },
    "levels": {
        **{f"{side}_score_{lv.lower()}_level_mean": _level_mean(side, lv) for side in ("demand", "supply") for lv in fixed.LEVELS},
        "demand_level_order_issue_flag": _order_flag("demand"),
        "supply_level_order_issue_flag": _order_flag("supply"),
    },
    "sufficiency": {
        "sufficiency_shortage_rule_violation_count": _n(SHORT),
        "sufficiency_balanced_rule_violation_count": _n(BALANCED),
        "sufficiency_surplus_rule_violation_count": _n(SURPLUS),
        "sufficiency_total_rule_violation_count": _n(f"{SHORT} OR {BALANCED} OR {SURPLUS}"),
    },
    "booleans": {"invalid_pest_indicator_type_count": _n("pest_indicator IS NULL")},
    "profit": {
        "positive_profit_count": _n("profit > 0"),
        "negative_profit_count": _n("profit < 0"),
        "zero_profit_count": _n("profit = 0"),
        "positive_profit_pct": f"round({_n('profit > 0')} * 1e0 / count(*) * 100, 2)",
        "negative_profit_pct": f"round({_n('profit < 0')} * 1e0 / count(*) * 100, 2)",
        "zero_profit_pct": f"round({_n('profit = 0')} * 1e0 / count(*) * 100, 4)",
        "avg_profit": "avg(profit)",
    },
}
for _section, _section_rules in RULES.items():
    ORACLES[f"dq_{_section}"] = _rules(_section, _section_rules)

FARM_COLUMNS = [
    "record_id", "crop_name", "planting_date", "harvest_date", "season", "area_size", "quantity_sold", "inventory_remaining", "unit_price",
    "total_sales", "total_expenses", "fertilizer_used", "water_used", "actual_yield", "profit", "sale_date", "sale_gap_days", "market_location",
    "farm_location", "region_type", "distance_to_market", "transport_cost", "customer_type", "market_price", "temperature", "humidity", "rainfall",
    "wind_speed", "pest_indicator", "water_efficiency", "fertilizer_efficiency", "demand_score", "demand_level", "supply_score", "supply_level",
    "sufficiency_status",
]
OVERVIEW = {
    "row_count": "(SELECT count(*) FROM farm)",
    "column_count": "36",
    "missing_values_total": "(SELECT " + " + ".join(f"count(*) - count({c})" for c in FARM_COLUMNS) + " FROM farm)",
    "duplicate_rows": "(SELECT count(*) FROM farm) - (SELECT count(*) FROM (SELECT DISTINCT * FROM farm))",
}
ORACLES["dq_overview"] = _farm(_union(f"SELECT 'overview' AS section, '{n}' AS rule, CAST({q} AS DOUBLE) AS value" for n, q in OVERVIEW.items()))
IDS = {
    "record_id_unique": "count(*) = count(DISTINCT record_id)", "record_id_duplicates": "count(*) - count(DISTINCT record_id)",
    "record_id_min": "min(record_id)", "record_id_max": "max(record_id)",
    "record_id_missing_sequence_count": "max(record_id) - min(record_id) + 1 - count(DISTINCT record_id)",
}
ORACLES["dq_record_id"] = _farm(_union(f"SELECT 'record_id' AS section, '{n}' AS rule, CAST({q} AS DOUBLE) AS value FROM farm" for n, q in IDS.items()))
ORACLES["dq_median_profit"] = _farm("SELECT 'profit' AS section, 'median_profit' AS rule, round(quantile_cont(profit, 0.5), 9) AS value FROM farm")


def _required(absent: tuple[str, ...]) -> str:
    """A column is missing if it is not there or has no value at all."""
    missing = {c: "max(1e0)" if c in absent else f"CAST(count({c}) = 0 AS DOUBLE)" for c in fixed.REQUIRED_COLUMNS}
    rows = [f"SELECT 'required' AS section, 'missing_{c}' AS rule, {q} AS value FROM farm" for c, q in missing.items()]
    total = " + ".join(missing.values())
    return _farm(_union([*rows, f"SELECT 'required' AS section, 'missing_required_columns_count' AS rule, {total} AS value FROM farm"]))


ORACLES["dq_required"] = _required(("wind_speed", "profit"))


def _flag(name: str, *conditions: str) -> str:
    return f"SELECT '{name}' AS flag, coalesce(({' OR '.join(conditions)}), false) AS raised FROM records"


ORACLES["dq_warnings"] = _farm(
    _union([
        _flag("has_missing_values", f"any_value({OVERVIEW['missing_values_total']}) > 0"),
        _flag("has_duplicate_rows", f"any_value({OVERVIEW['duplicate_rows']}) > 0"),
        _flag("has_invalid_categories", *[f"{q} > 0" for q in RULES["categories"].values()]),
        _flag("has_bad_date_order", f"{RULES['dates']['bad_date_order_count']} > 0"),
        _flag("has_sales_yield_issue", f"{RULES['yield_sales']['quantity_sold_gt_actual_yield_count']} > 0"),
        _flag("has_score_range_issue", *[f"{RULES['ranges'][f'{x}_score_out_of_range_count']} > 0" for x in ("demand", "supply")]),
        _flag("has_price_issues", *[f"{q} > 0" for q in list(RULES["prices"].values())[:4]]),
        _flag("has_profit_formula_issues", f"{RULES['finance']['profit_formula_mismatch_count']} > 0"),
        _flag("has_sufficiency_rule_issues", f"{RULES['sufficiency']['sufficiency_total_rule_violation_count']} > 0"),
        _flag("demand_level_order_issue", f"({_order_flag('demand')}) = 1"),
        _flag("supply_level_order_issue", f"({_order_flag('supply')}) = 1"),
        _flag("desert_temp_logic_issue", RULES["weather"]["desert_not_hotter_than_rural_flag"]),
        _flag("desert_water_logic_issue", RULES["resources"]["desert_water_not_higher_than_rural_flag"]),
        _flag("pest_logic_issue", RULES["pests"]["pest_not_higher_in_high_risk_flag"]),
    ]), RECORDS)

# --- allocation -----------------------------------------------------------------------

CANDIDATES = """farm_crops AS (
  SELECT o_custkey AS farm, p_brand AS crop, max(p_retailprice / 10e0) AS profit, max(1e0 + l_discount * 100e0) AS water_per_area,
    max(1e0 + l_tax * 100e0) AS fert_per_area, CAST(o_custkey % 50 + 10 AS DOUBLE) AS area
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, p_brand)"""
TARGETS = CANDIDATES + """,
targets AS (SELECT *, area * s / sum(s) OVER (PARTITION BY farm) AS target, count(*) OVER (PARTITION BY farm) AS n FROM
  (SELECT *, exp(0.08e0 * (profit - max(profit) OVER (PARTITION BY farm))) AS s FROM farm_crops))"""
ORACLES["softmax_shares"] = _with(TARGETS) + "SELECT farm, crop, round(target, 6) AS target FROM targets"


def _bounded(low: float, high: float) -> str:
    return _with(CANDIDATES) + f"""
  , ranked AS (SELECT *, count(*) OVER w AS n, sum(profit) OVER w AS weight, row_number() OVER (PARTITION BY farm ORDER BY profit DESC, crop) AS k
    FROM farm_crops WINDOW w AS (PARTITION BY farm)),
  split AS (SELECT farm, crop, profit, CASE WHEN n * {low} <= 1 + 1e-12 AND n * {high} >= 1 - 1e-12 THEN 'optimized' ELSE 'fallback' END AS status,
      CASE WHEN n * {low} <= 1 + 1e-12 AND n * {high} >= 1 - 1e-12
        THEN area * {low}e0 + greatest(0, least(area * {high}e0 - area * {low}e0, area - n * area * {low}e0 - (k - 1) * (area * {high}e0 - area * {low}e0)))
        ELSE area * profit / nullif(weight, 0) END AS x FROM ranked)
  SELECT farm, crop, round(x, 6) AS allocation, status,
    CASE WHEN status = 'optimized' THEN round(sum(x * profit) OVER (PARTITION BY farm), 6) END AS total_profit FROM split"""


ORACLES["allocate_bounded"] = _bounded(0.05, 0.40)
ORACLES["allocate_fallback"] = _with(CANDIDATES) + """
  SELECT farm, crop, round(area * profit / sum(profit) OVER (PARTITION BY farm), 6) AS allocation, 'fallback' AS status,
    CAST(NULL AS DOUBLE) AS total_profit FROM farm_crops"""
SMOOTH = TARGETS + """,
fits AS (SELECT * FROM targets WHERE n * 0.05e0 <= 1 + 1e-9 AND n * 0.4e0 >= 1 - 1e-9),
points AS (SELECT DISTINCT farm, x FROM (
  SELECT farm, profit + 0.7e0 * (target - area * 0.4e0) AS x FROM fits UNION ALL SELECT farm, profit + 0.7e0 * (target - area * 0.05e0) FROM fits)),
curve AS (SELECT p.farm, p.x, any_value(f.area) AS area, sum(greatest(area * 0.05e0, least(area * 0.4e0, target + (profit - x) / 0.7e0))) AS total
  FROM points p JOIN fits f USING (farm) GROUP BY p.farm, p.x),
ends AS (SELECT farm, any_value(area) AS area, max(x) FILTER (WHERE total >= area - area * 1e-9) AS x0, min(x) FILTER (WHERE total <= area + area * 1e-9) AS x1
  FROM curve GROUP BY farm),
price AS (SELECT e.farm, x0 + coalesce((a.total - e.area) * (x1 - x0) / nullif(a.total - b.total, 0), 0) AS y
  FROM ends e JOIN curve a ON a.farm = e.farm AND a.x = x0 JOIN curve b ON b.farm = e.farm AND b.x = x1),
smooth AS (SELECT t.*, CASE WHEN y IS NOT NULL THEN greatest(area * 0.05e0, least(area * 0.4e0, target + (profit - y) / 0.7e0)) END AS allocation,
  CASE WHEN y IS NULL THEN 'infeasible' ELSE 'optimized' END AS status FROM targets t LEFT JOIN price USING (farm))"""
ORACLES["allocate_smooth"] = _with(SMOOTH) + "SELECT farm, crop, round(target, 6) AS target, round(allocation, 6) AS allocation, status FROM smooth"

# Whether both limits can hold together: for every weight between them, the least weighted use must fit.
# The least use is concave in the weight, so the weights at which two crops change places are enough.
FEASIBLE = """bent AS (SELECT *, row_number() OVER (PARTITION BY farm ORDER BY crop) AS i FROM targets WHERE n * 0.05e0 <= 1 + 1e-9 AND n * 0.4e0 >= 1 - 1e-9),
weights AS (SELECT DISTINCT a.farm, (b.fert_per_area - a.fert_per_area) / ((a.water_per_area - a.fert_per_area) - (b.water_per_area - b.fert_per_area)) AS th
  FROM bent a JOIN bent b ON a.farm = b.farm AND a.i < b.i WHERE (a.water_per_area - a.fert_per_area) <> (b.water_per_area - b.fert_per_area)
  UNION SELECT farm, 0e0 FROM bent UNION SELECT farm, 1e0 FROM bent),
filled AS (SELECT farm, th, area, n, u, row_number() OVER (PARTITION BY farm, th ORDER BY u) AS k
  FROM (SELECT farm, th, area, n, th * water_per_area + (1 - th) * fert_per_area AS u FROM weights JOIN bent USING (farm) WHERE th BETWEEN 0 AND 1)),
least AS (SELECT farm, th, any_value(area) AS area,
    sum(u * (area * 0.05e0 + greatest(0, least(area * 0.35e0, area - n * area * 0.05e0 - (k - 1) * area * 0.35e0)))) AS used FROM filled GROUP BY farm, th),
possible AS (SELECT farm, bool_and(used <= area * (th * 7 + (1 - th) * 6.5e0) * (1 + 1e-9)) AS ok FROM least GROUP BY farm),
used AS (SELECT farm, sum(allocation * water_per_area) <= any_value(area) * 7e0 * (1 + 1e-12)
    AND sum(allocation * fert_per_area) <= any_value(area) * 6.5e0 * (1 + 1e-12) AS free FROM smooth GROUP BY farm)"""
ORACLES["allocate_resources"] = _with(SMOOTH, FEASIBLE) + """
  SELECT s.farm, s.crop, round(s.target, 6) AS target, CASE WHEN u.free THEN round(s.allocation, 6) END AS free_allocation,
    CASE WHEN coalesce(p.ok, false) THEN 'optimized' ELSE 'infeasible' END AS status, CAST(s.n AS BIGINT) AS crops,
    CASE WHEN p.ok THEN true END AS in_bounds, CASE WHEN p.ok THEN true END AS as_priced, CASE WHEN p.ok THEN true END AS sums_up,
    CASE WHEN p.ok THEN true END AS within_limits, CASE WHEN p.ok THEN true END AS slackness
  FROM smooth s LEFT JOIN possible p USING (farm) LEFT JOIN used u USING (farm)"""

ORACLES["allocation_report"] = _with(SMOOTH) + """
  SELECT farm, crop, row_number() OVER (PARTITION BY farm ORDER BY round(allocation, 6) DESC, crop) AS place, round(allocation, 6) AS crop_area,
    round(allocation / area * 100, 6) AS percentage, round(profit, 6) AS profit_per_hectare, round(profit * allocation, 6) AS total_profit_crop,
    round(water_per_area * allocation, 6) AS water_used_est, round(fert_per_area * allocation, 6) AS fertilizer_used_est,
    round(target, 6) AS target_area, round(sum(profit * allocation) OVER (PARTITION BY farm), 6) AS total_profit, status
  FROM smooth"""
ORACLES["recommendations"] = _with(CANDIDATES) + """
  , ranked AS (SELECT *, count(*) OVER w AS n, sum(profit) OVER w AS weight, row_number() OVER (PARTITION BY farm ORDER BY profit DESC, crop) AS k
    FROM farm_crops WINDOW w AS (PARTITION BY farm)),
  split AS (SELECT farm, crop, area, profit, CASE WHEN n * 0.05e0 <= 1 + 1e-12 AND n * 0.4e0 >= 1 - 1e-12
      THEN area * 0.05e0 + greatest(0, least(area * 0.4e0 - area * 0.05e0, area - n * area * 0.05e0 - (k - 1) * (area * 0.4e0 - area * 0.05e0)))
      ELSE area * profit / nullif(weight, 0) END AS x, n * 0.05e0 <= 1 + 1e-12 AND n * 0.4e0 >= 1 - 1e-12 AS fits FROM ranked),
  placed AS (SELECT *, CAST(round(CAST(x AS DECIMAL(18, 6)), 2) AS DOUBLE) AS a, CAST(round(CAST(x / area * 100 AS DECIMAL(18, 6)), 2) AS DOUBLE) AS pct,
    row_number() OVER (PARTITION BY farm ORDER BY round(x, 6) DESC, crop) AS place FROM split)
  SELECT farm, CASE WHEN any_value(fits) THEN 'optimized' ELSE 'fallback' END AS status, 'Recommended planting plan:' || chr(10)
      || string_agg('- ' || crop || ': ' || a || ' area units (' || pct || '%)', chr(10) ORDER BY place)
      || chr(10) || 'Largest share: ' || arg_min(crop, place) || ' with ' || arg_min(a, place) || ' area units.'
      || chr(10) || 'Expected total profit: ' || printf('%.2f', CAST(round(CAST(sum(profit * x) AS DECIMAL(18, 6)), 2) AS DOUBLE)) AS recommendation
  FROM placed GROUP BY farm"""

# --- requests -------------------------------------------------------------------------

REQUESTS = CROPS + f""",
cropped AS (
  SELECT p.*, coalesce(c.crop_name, p.p_brand) AS crop_name, CAST(substr(p_brand, 7) AS BIGINT) AS brand_no
  FROM part p LEFT JOIN crop_facts c ON c.crop_no = CAST(substr(p_brand, 7) AS BIGINT) AND c.crop_no <= 20),
requests AS (
  SELECT l_orderkey * 10 + l_linenumber AS request_id, crop_name, {PLACE.format(k='n_nationkey', n='n_name')} AS governorate,
    CAST(p_size - 3 AS DOUBLE) AS area_donums, CAST(o_orderdate AS DATE) AS planting, CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS sale
  FROM lineitem JOIN cropped ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""
KNOWN = _list(row[0] for row in fixed.place_rows())
ORACLES["request_validation"] = _with(REQUESTS) + f"""
  SELECT request_id, concat_ws('; ', CASE WHEN NOT area_donums > 0 THEN 'area not positive' END, CASE WHEN governorate NOT IN ({KNOWN}) THEN 'unknown governorate' END,
      CASE WHEN sale IS NULL THEN 'unreadable sale date' END, CASE WHEN sale <= planting THEN 'sale not after planting' END) AS reasons,
    CASE WHEN governorate IN ({_list(fixed.MARKET_OPTIONS)}) THEN '' ELSE 'unlisted market' END AS warnings FROM requests"""
BALANCE = """crops AS (SELECT DISTINCT brand_no AS id, CASE WHEN brand_no = 4 THEN 'Old ' ELSE '' END || crop_name AS crop_name FROM cropped),
stock AS (SELECT brand_no AS id, l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day, l_quantity AS tons FROM lineitem JOIN cropped ON l_partkey = p_partkey),
last AS (SELECT id, flag, tons FROM stock QUALIFY row_number() OVER (PARTITION BY id, flag ORDER BY day DESC, tons DESC) = 1),
balance AS (SELECT crop_name, s.tons AS supply, d.tons AS demand FROM crops LEFT JOIN (SELECT * FROM last WHERE flag = 'A') s USING (id)
  LEFT JOIN (SELECT * FROM last WHERE flag = 'N' AND id <> 6) d USING (id))"""
ORACLES["latest_balance"] = _with(REQUESTS, BALANCE) + "SELECT * FROM balance"
WEATHER = f"""weather AS (SELECT CASE WHEN user_id % 12 = 5 THEN 'Elsewhere' ELSE ([{KNOWN}])[user_id % 12 + 1] END AS governorate, value AS temperature, CAST(event_id % 100 AS DOUBLE) AS humidity,
    CAST(event_id % 7 AS DOUBLE) AS rainfall, CAST(user_id % 30 AS DOUBLE) AS wind_speed FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id % 12 ORDER BY ts DESC, value DESC) = 1)"""
ORACLES["latest_weather"] = _with(WEATHER) + "SELECT * FROM weather"
PLACES = f"places(governorate, coarse, region_type, lat, lon) AS (SELECT * FROM {_values(fixed.place_rows())})"
ORACLES["request_enrichment"] = _farm(
    """SELECT request_id, r.crop_name, r.governorate, replace(r.governorate, '''', '') AS farm_location, region_type,
      round(coalesce(nullif(coalesce(b.supply, 0), 0), base.supply, 0), 6) AS supply, coalesce(b.demand, 0) AS demand,
      CAST(CASE WHEN coalesce(b.demand, 0) = 0 THEN 0 WHEN coalesce(b.supply, 0) / b.demand > 1.2e0 THEN 0 WHEN coalesce(b.supply, 0) / b.demand < 0.8e0 THEN 2 ELSE 1 END AS BIGINT) AS demand_level_ord,
      CASE WHEN coalesce(b.demand, 0) = 0 THEN 'Balanced' WHEN coalesce(b.supply, 0) > b.demand * 1.2e0 THEN 'Surplus'
        WHEN coalesce(b.supply, 0) < b.demand * 0.8e0 THEN 'Deficit' ELSE 'Balanced' END AS sufficiency_status,
      round(coalesce(base.market_price, 100), 6) AS market_price, round(area_donums * 0.1e0, 6) AS area_size,
      round(coalesce(fertilizer_per_ha, 0) * (area_donums * 0.1e0), 6) AS fertilizer_used, round(coalesce(water_per_ha, 0) * (area_donums * 0.1e0), 6) AS water_used,
      coalesce(w.temperature, 20) AS temperature, coalesce(w.humidity, 50) AS humidity, coalesce(w.rainfall, 0) AS rainfall, coalesce(w.wind_speed, 0) AS wind_speed
    FROM requests r JOIN places USING (governorate) LEFT JOIN weather w USING (governorate) LEFT JOIN balance b ON b.crop_name = r.crop_name
    LEFT JOIN base ON base.crop_name = r.crop_name WHERE area_donums > 0 AND sale > planting""",
    BASE, REQUESTS[REQUESTS.index("requests AS"):], BALANCE, WEATHER, PLACES)

# --- models ---------------------------------------------------------------------------

ORACLES["regression_metrics"] = _farm(
    """SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae
    FROM (SELECT actual_yield AS y, quantity_sold * 1.1e0 AS p FROM farm)""")
ORACLES["classification_metrics"] = _farm(
    """SELECT round(sum(tp) / any_value(total), 9) AS accuracy, round(sum(CASE WHEN pr + re = 0 THEN 0 ELSE support * (2 * pr * re / (pr + re)) END) / any_value(total), 9) AS f1,
      round(sum(support * pr) / any_value(total), 9) AS weighted_precision, round(sum(support * re) / any_value(total), 9) AS weighted_recall FROM stats""",
    """labelled AS (SELECT demand_level AS y, CASE WHEN demand_score < 0.36e0 THEN 'Low' WHEN demand_score < 0.64e0 THEN 'Medium' ELSE 'High' END AS p
      FROM farm)""",
    """stats AS (SELECT c, support, tp, total, coalesce(tp / nullif(predicted, 0), 0) AS pr, tp / support AS re FROM (
      SELECT c, (SELECT count(*) FROM labelled WHERE y = c) * 1e0 AS support, (SELECT count(*) FROM labelled WHERE p = c) * 1e0 AS predicted,
        (SELECT count(*) FROM labelled WHERE y = c AND p = c) * 1e0 AS tp, (SELECT count(*) FROM labelled) * 1e0 AS total
      FROM (VALUES ('Low'), ('Medium'), ('High')) v(c)))""")
ORACLES["fit_verdict"] = _farm(
    """SELECT crop_name, CASE WHEN max(supply_score) - avg(demand_score * 1.42e0) > 0.05e0 THEN 'Overfitting'
      WHEN avg(demand_score * 1.42e0) < 0.7e0 THEN 'Underfitting' ELSE 'Well-balanced' END AS verdict FROM farm GROUP BY 1""")
ORACLES["hash_split"] = """SELECT CASE WHEN (o_orderkey * 7919 + 42) % 100 < 80 THEN 'train' ELSE 'test' END AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys
  FROM orders GROUP BY 1"""
ORACLES["leaderboard"] = _farm(
    """SELECT * FROM (SELECT model, r2, 'best' AS version FROM board ORDER BY r2 DESC, model LIMIT 1) UNION ALL SELECT model, r2, 'all' FROM board""",
    "board AS (SELECT region_type AS model, round(corr(actual_yield, quantity_sold), 9) AS r2 FROM farm GROUP BY 1)")
ORACLES["profit_inputs"] = _farm(
    "SELECT record_id, crop_name, farm_location, area_size, fertilizer_used, water_used, actual_yield, market_price, humidity, rainfall, wind_speed, profit, "
    + ", ".join(f"CASE {c} WHEN 'Low' THEN 0e0 WHEN 'Medium' THEN 1e0 WHEN 'High' THEN 2e0 END AS {n}" for c, n in (("supply_level", "supply_level"), ("demand_level", "demand_level_ord")))
    + ", " + ", ".join(f"CAST({u}({p}_date) AS BIGINT) AS {p}_{u}" for p in ("planting", "sale") for u in ("year", "month", "day"))
    + " FROM farm")

# Elastic net of one scaled input in closed form, judged on each third by the model of the other two.
ORACLES["tune_linear"] = _farm(
    """SELECT reg AS "regParam", el AS "elasticNetParam", round(r2, 9) AS r2, row_number() OVER (ORDER BY r2 DESC, reg, el) = 1 AS best FROM scored""",
    """pairs AS MATERIALIZED (SELECT quantity_sold AS x, profit AS y, record_id % 3 AS fold FROM farm WHERE profit IS NOT NULL AND quantity_sold IS NOT NULL)""",
    """grid AS (SELECT reg, el FROM (SELECT unnest([0e0, 0.01e0, 0.1e0]) AS reg), (SELECT unnest([0e0, 0.5e0, 1e0]) AS el))""",
    """others AS (SELECT k, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, corr(x, y) AS r
      FROM pairs, (SELECT unnest([0, 1, 2]) AS k) WHERE fold <> k GROUP BY k)""",
    """lines AS (SELECT k, reg, el, mx, my, sign(r) * greatest(abs(r) - reg / sy * el, 0) / (1 + reg / sy * (1 - el)) * sy / sx AS b FROM others, grid)""",
    """folds AS (SELECT k, reg, el, 1 - sum((y - my - b * (x - mx)) ** 2) / (var_pop(y) * count(*)) AS r2 FROM lines JOIN pairs ON fold = k GROUP BY ALL)""",
    """scored AS (SELECT reg, el, avg(r2) AS r2 FROM folds GROUP BY ALL)""")


def _regression(name: str, x: str, y: str, where: str = "true") -> str:
    return f"{name} AS (SELECT regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a FROM farm WHERE {where})"


YIELD_LINE = _regression("yield_line", "area_size", "actual_yield")
PROFIT_LINE = _regression("profit_line", "actual_yield", "profit")
PRICE_LINE = _regression("price_line", "sale_gap_days", "market_price")
ORACLES["line_score_table"] = _farm("SELECT record_id, round(a + b * area_size, 6) AS prediction FROM farm, yield_line", YIELD_LINE)
VALID = "area_donums > 0 AND sale > planting"
_ASKED = REQUESTS[REQUESTS.index("requests AS"):]
ORACLES["line_score_yield"] = _farm(
    f"""SELECT request_id, crop_name, round(a + b * (area_donums * 0.1e0), 6) AS predicted_yield
    FROM requests JOIN places USING (governorate), yield_line WHERE {VALID}""", _ASKED, PLACES, YIELD_LINE)
ORACLES["line_stream_scores"] = ORACLES["line_score_yield"]
ORACLES["line_score_profit"] = _farm(
    f"""SELECT request_id, crop_name, round(y.a + y.b * (area_donums * 0.1e0), 6) AS actual_yield,
      round(p.a + p.b * (y.a + y.b * (area_donums * 0.1e0)), 6) AS predicted_profit
    FROM requests JOIN places USING (governorate), yield_line y, profit_line p WHERE {VALID}""", _ASKED, PLACES, YIELD_LINE, PROFIT_LINE)
ORACLES["line_score_price"] = _farm(
    f"""SELECT request_id, crop_name, round(a + b * greatest(datediff('day', DATE '1998-01-01', sale), 0), 6) AS predicted_price
    FROM requests JOIN places USING (governorate), price_line WHERE {VALID}""", _ASKED, PLACES, PRICE_LINE)
# Naive Bayes of two counts: shares of the labels and of the counts within a label, each plus one.
ORACLES["bayes_score_demand"] = _farm(
    f"""SELECT request_id, crop_name, (SELECT arg_max(level, prior + gap * days + damp * wet) FROM learned) AS value FROM (
      SELECT request_id, crop_name, greatest(datediff('day', DATE '1998-01-01', sale), 0) AS days, coalesce(humidity, 50) AS wet
      FROM requests JOIN places USING (governorate) LEFT JOIN weather USING (governorate) WHERE {VALID})""",
    """learned AS (SELECT demand_level AS level, ln(count(*) + 1) AS prior, ln(sum(sale_gap_days) + 1) - ln(sum(sale_gap_days) + sum(humidity) + 2) AS gap,
      ln(sum(humidity) + 1) - ln(sum(sale_gap_days) + sum(humidity) + 2) AS damp FROM farm WHERE demand_level IS NOT NULL GROUP BY 1)""",
    _ASKED, PLACES, WEATHER)

_NAMES = _list(row[1] for row in fixed.crop_rows())
CHOICES = f"""picked AS (
  SELECT o_orderkey AS request_id, CAST(o_orderkey % 90 + 10 AS DOUBLE) * 0.1e0 AS area,
    list_transform([1, 2, 3, 5, 7, 11], lambda m: ([{_NAMES}])[(o_orderkey * m + m) % {len(fixed.crop_rows())} + 1]) AS crops
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE {PLACE.format(k='n_nationkey', n='n_name')} IN ({KNOWN})),
listed AS (SELECT request_id, area, list_filter(crops, lambda c, i: list_position(crops, c) = i) AS crops FROM picked),
choices AS (SELECT request_id, area, unnest(crops) AS crop_name, unnest(range(len(crops))) AS position FROM listed),
predicted AS (SELECT c.*, greatest(p.a + p.b * coalesce(base.yield_per_ha, 0), 0) AS profit, coalesce(base.market_price, 100) AS price
  FROM choices c LEFT JOIN base USING (crop_name), profit_line p),
candidates AS (SELECT request_id, area, crop_name, position,
    CASE WHEN max(profit) OVER (PARTITION BY request_id) = 0 THEN price ELSE profit END AS profit FROM predicted)"""
ORACLES["line_optimise_requests"] = _farm(
    """SELECT request_id, position, crop_name, round(area, 6) AS area_hectares, round(profit, 6) AS profit_per_hectare, round(x, 6) AS allocation, status,
      round(CASE WHEN status = 'optimized' THEN sum(x * profit) OVER (PARTITION BY request_id) ELSE 0 END, 6) AS expected_total_profit FROM (
      SELECT *, CASE WHEN n >= 3 THEN 'optimized' ELSE 'fallback' END AS status,
        CASE WHEN n >= 3 THEN area * 0.05e0 + greatest(0, least(area * 0.35e0, area - n * area * 0.05e0 - (k - 1) * area * 0.35e0))
          ELSE area * profit / nullif(weight, 0) END AS x FROM (
        SELECT *, count(*) OVER w AS n, sum(profit) OVER w AS weight, row_number() OVER (PARTITION BY request_id ORDER BY profit DESC, crop_name) AS k
        FROM candidates WINDOW w AS (PARTITION BY request_id)))""", BASE, PROFIT_LINE, CHOICES)
ORACLES["line_plan_requests"] = _farm(
    """SELECT request_id, CASE WHEN count(*) >= 3 THEN 'optimized' ELSE 'infeasible' END AS status, count(*) AS crops, CASE WHEN count(*) >= 3 THEN true END AS in_bounds, CASE WHEN count(*) >= 3 THEN true END AS as_priced, CASE WHEN count(*) >= 3 THEN true END AS sums_up, CASE WHEN count(*) >= 3 THEN true END AS within_limits, CASE WHEN count(*) >= 3 THEN true END AS slackness,
      round(sum(profit), 6) AS profit, round(sum(w), 6) AS water_per_area, round(sum(f), 6) AS fert_per_area
    FROM candidates LEFT JOIN needs USING (crop_name) GROUP BY request_id""", BASE, PROFIT_LINE, CHOICES,
    """needs AS (SELECT crop_name, quantile_cont(water_used / greatest(area_size, 1e-6), 0.5) AS w,
      quantile_cont(fertilizer_used / greatest(area_size, 1e-6), 0.5) AS f FROM farm GROUP BY 1)""")
ORACLES["crop_lookup"] = _with(REQUESTS) + """
  SELECT request_id, r.crop_name, c.id AS crop_id, round(coalesce(c.y, 0), 6) AS avg_yield_per_donum FROM requests r
  LEFT JOIN (SELECT brand_no AS id, crop_name, avg(p_size) AS y FROM cropped WHERE brand_no <> 4 GROUP BY ALL) c USING (crop_name)"""

_LINES = {"by area": "area_size", "by water": "water_used", "by fertilizer": "fertilizer_used", "by rain": "rainfall"}
_SPLIT = "halves AS (SELECT *, (record_id * 7919 + 42) % 100 < 80 AS train FROM farm WHERE actual_yield IS NOT NULL)"


def _line_board(reg: float) -> str:
    return _union(
        f"SELECT '{name}' AS model, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae"
        f" FROM (SELECT actual_yield AS y, my + b * ({x} - mx) AS p FROM halves, (SELECT avg(actual_yield) AS my, avg({x}) AS mx,"
        f" regr_slope(actual_yield, {x}) / (1 + {reg}e0 / stddev_pop(actual_yield)) AS b FROM halves WHERE train) WHERE NOT train)"
        for name, x in _LINES.items())


ORACLES["line_board"] = _farm(
    "SELECT model, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM board", _SPLIT, f"board AS ({_line_board(0.0)})")
ORACLES["version_comparison"] = _farm(
    """SELECT 'untuned' AS version, arg_max(model, r2) AS model, round(max(r2), 6) AS score FROM plain
    UNION ALL SELECT 'tuned', arg_max(model, r2), round(max(r2), 6) FROM bent""", _SPLIT, f"plain AS ({_line_board(0.0)})", f"bent AS ({_line_board(5.0)})")



def _indexed(name: str, column: str, rows: str = "farm") -> str:
    """Labels by falling count, equal ones in order, and their shares."""
    return (f"{name} AS (SELECT {column} AS label, row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS i, count(*) / sum(count(*)) OVER () AS p,"
            f" sum(count(*)) OVER () AS total FROM {rows} GROUP BY 1)")


_OWN = "round((1 - {0}.p) / sqrt({0}.p * (1 - {0}.p) * {0}.total / ({0}.total - 1)), 6)"
ORACLES["encoded_features"] = _farm(
    f"""SELECT record_id, CAST(r.i AS BIGINT) AS region_index, CAST(s.i AS BIGINT) AS season_index,
      round((area_size - m) / d, 6) AS area, {_OWN.format('r')} AS region, {_OWN.format('s')} AS season
    FROM farm JOIN r ON r.label = region_type JOIN s ON s.label = season, (SELECT avg(area_size) AS m, stddev_samp(area_size) AS d FROM farm)""",
    _indexed("r", "region_type"), _indexed("s", "season"))
ORACLES["unseen_labels"] = _farm(
    _union(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL OR {c} NOT IN (SELECT {c} FROM halves WHERE train AND region_type <> 'Desert' AND {c} IS NOT NULL)) AS unseen"
           " FROM halves WHERE NOT train" for c in ("crop_name", "farm_location", "region_type")),
    "halves AS MATERIALIZED (SELECT *, (record_id * 7919 + 42) % 100 < 80 AS train FROM farm)")
_LEARNED = ORACLES["bayes_score_demand"][ORACLES["bayes_score_demand"].index("learned AS"):].split("FROM farm WHERE demand_level IS NOT NULL GROUP BY 1)")[0] + "FROM farm WHERE demand_level IS NOT NULL GROUP BY 1)"
ORACLES["bayes_levels"] = _farm(
    """SELECT demand_level, predicted AS predicted_demand_level, count(*) AS n FROM (SELECT demand_level,
      (SELECT arg_max(level, prior + gap * sale_gap_days + damp * humidity) FROM learned) AS predicted FROM farm WHERE demand_level IS NOT NULL) GROUP BY ALL""",
    _LEARNED)
ORACLES["bake_off_line"] = _farm(
    """SELECT 'line' AS model, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae
    FROM (SELECT y, y - my - b1 * (x - mx) - b2 * (z - mz) AS e FROM (
      SELECT *, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b1, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS b2 FROM points, (
        SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS sxx, var_pop(z) AS szz, covar_pop(x, z) AS sxz, covar_pop(x, y) AS sxy, covar_pop(z, y) AS szy
        FROM points WHERE train)) WHERE NOT train)""",
    """halves AS MATERIALIZED (SELECT record_id, region_type, unit_price, market_price, (record_id * 7919 + 42) % 100 < 80 AS train FROM farm
      WHERE region_type IS NOT NULL AND unit_price IS NOT NULL AND market_price IS NOT NULL)""",
    _indexed("r", "region_type", "(SELECT * FROM halves WHERE train)"),
    "points AS (SELECT unit_price AS x, coalesce(r.i, (SELECT count(*) FROM r)) * 1e0 AS z, market_price AS y, train FROM halves LEFT JOIN r ON r.label = region_type)")
ORACLES["inventory_left"] = _farm("SELECT record_id, round(greatest(actual_yield - quantity_sold * 1.1e0, 0), 6) AS inventory_left FROM farm")
ORACLES["dropped_nulls"] = _farm(
    """SELECT record_id, total_sales, CAST(area_size AS BIGINT) AS area_size, TRY_CAST(crop_name AS BIGINT) AS crop_name FROM farm
    WHERE customer_type IS NOT NULL AND total_sales IS NOT NULL""")
ORACLES["capped_sample"] = _farm("SELECT record_id, round(profit, 6) AS profit FROM (SELECT record_id, profit FROM farm ORDER BY profit, record_id LIMIT 500)")

# --- the whole report -----------------------------------------------------------------

_REPORT = [ORACLES[f"dq_{name}"] for name in ["overview", "record_id", "median_profit", *RULES]]
_REPORT.append(_required(()))
_REPORT.append(
    f"SELECT 'distribution' AS section, attribute || '_' || category || '_share_pct' AS rule, share_pct AS value FROM ({ORACLES['category_shares']})")
_REPORT.append(_farm(_union(
    f"SELECT 'groups' AS section, '{key}_{name}_mean_{f}' AS rule, {f}(m) AS value"
    f" FROM (SELECT avg({column}) AS m FROM farm WHERE {key} IS NOT NULL GROUP BY {key})"
    for key, column, name in (("crop_name", "profit", "profit"), ("region_type", "profit", "profit"), ("customer_type", "total_sales", "sales"))
    for f in ("max", "min"))))
_REPORT.append(_farm(_union(
    f"SELECT 'distribution' AS section, 'crop_{f}_share_pct' AS rule, {f}(n) * 100e0 / sum(n) AS value FROM counts" for f in ("max", "min")),
    "counts AS (SELECT crop_name, count(*) AS n FROM farm GROUP BY 1)"))
_REPORT.append(f"SELECT 'correlation' AS section, pair AS rule, corr AS value FROM ({ORACLES['correlations']})")
_REPORT.append(
    f"SELECT 'outliers' AS section, column_name || '_outlier_count_iqr' AS rule, CAST(outliers AS DOUBLE) AS value FROM ({ORACLES['iqr_outliers']})")
ORACLES["dq_report"] = _union(f"SELECT section, rule, round(value, 6) AS value FROM ({q})" for q in _REPORT)
