"""Global order without a single-task window: consecutive ids and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from furrow.operators.joins import lookup_join
from furrow.session import cut_lineage, shuffle_partitions

# monotonically_increasing_id keeps the partition number above bit 33.
POSITION_BITS = 33
ACCURACY = 10_000
# Half width of a bracket, five times the rank error of the sketch. Groups of up to
# SMALL_GROUP rows keep all values: there a bracket would be under ten ranks wide.
SLACK = 5.0 / ACCURACY
SMALL_GROUP = 10_000


def sequential_ids(
    df: DataFrame, order: Sequence[str | Column], id_col: str = "record_id", partitions: int | None = None
) -> DataFrame:
    """Number the rows 1..n in the given order.

    Rows are range-partitioned and sorted per partition; each row's id is its position
    plus the row count of earlier partitions. Equal rows are split by the partition
    they come from, so copies do not pile up in one task. The offsets table has at
    most one row per partition.
    """
    parts = partitions or shuffle_partitions(df.sparkSession)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut_lineage(
        df.withColumn("_from", F.spark_partition_id())
        .repartitionByRange(parts, *order_cols, F.col("_from"))
        .sortWithinPartitions(*order_cols, F.col("_from"))
        .withColumn("_place", F.monotonically_increasing_id())
        .drop("_from")
    )
    block = F.shiftright("_place", POSITION_BITS)
    sizes = placed.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    position = F.col("_place") - F.shiftleft(F.col("_block"), POSITION_BITS)
    numbered = placed.withColumn("_block", block).join(F.broadcast(offsets), "_block")
    return numbered.select((F.col("_offset") + position + 1).cast("long").alias(id_col), *df.columns)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per (keys, measure), columns q0, q1, ...

    A first scan takes bounded sketches that bracket each wanted rank, one per column and group, side by
    side in one row. A second scan
    keeps the values inside the brackets and only counts those between them, so almost
    nothing is shuffled. The kept values are range-partitioned and only the blocks that
    hold a wanted rank are sorted. Should a bracket miss its rank, all values are used.
    """
    parts = partitions or shuffle_partitions(df.sparkSession)
    group = [*keys, "measure"]
    # NaN is missing, too
    wide = df.selectExpr(*keys, *[f"nullif(cast({c} as double), double('NaN')) as {c}" for c in columns])
    cells = ", ".join(f"'{c}', {c}" for c in columns)
    long = wide.selectExpr(*keys, f"stack({len(columns)}, {cells}) as (measure, value)").where("value is not null")

    edges = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-SLACK, SLACK)]
    sketches = [x for c in columns for x in (F.percentile_approx(c, edges, ACCURACY).alias(f"_cuts_{c}"), F.count(c).alias(f"_n_{c}"))]
    cuts = wide.groupBy(*keys).agg(*sketches).selectExpr(
        *keys, "inline(array(" + ", ".join(f"struct('{c}' as measure, _cuts_{c} as _cuts, _n_{c} <= {SMALL_GROUP} as _small)" for c in columns) + "))"
    ).where("_cuts is not null")
    seen = Observation()
    picked = _pick(_counted(long, cuts, group, len(probs)), group, probs, parts)
    picked = cut_lineage(picked.observe(seen, F.coalesce(F.bool_or("_missed"), F.lit(False)).alias("missed")))
    if seen.get["missed"]:
        whole = long.withColumn("_gap", F.lit(False)).groupBy(*group, "value", "_gap").agg(F.count(F.lit(1)).alias("_n"))
        picked = _pick(whole, group, probs, parts)
    return picked.drop("_missed")


def _counted(long: DataFrame, cuts: DataFrame, group: list[str], n_probs: int) -> DataFrame:
    """Value counts, where values outside all brackets fall onto the nearest lower edge."""
    joined = lookup_join(long, cuts, group, how="inner", null_safe=True)
    edges = [(f"_cuts[{2 * i}]", f"_cuts[{2 * i + 1}]") for i in range(n_probs)]
    inside = " or ".join(["_small", *[f"value between {low} and {high}" for low, high in edges]])
    below = "double('-Infinity')"
    lower_edge = ", ".join(f"if(value > {high}, {high}, {below})" for _, high in edges)
    snapped = joined.selectExpr(
        *group, f"if({inside}, value, greatest({below}, {lower_edge})) as value", f"not ({inside}) as _gap"
    )
    return snapped.groupBy(*group, "value", "_gap").agg(F.count(F.lit(1)).alias("_n"))


def _pick(counted: DataFrame, group: list[str], probs: Sequence[float], parts: int) -> DataFrame:
    blocks = cut_lineage(
        counted.repartitionByRange(parts, *group, "value", "_gap").withColumn("_block", F.spark_partition_id())
    )
    names = ", ".join(group)
    upto = f"sum(_rows) over (partition by {names} order by _block)"
    sizes = (
        blocks.groupBy(*group, "_block")
        .agg(F.sum("_n").alias("_rows"))
        .selectExpr("*", f"sum(_rows) over (partition by {names}) as _total", f"{upto} as _upto", f"{upto} - _rows as _offset")
    )
    place = [f"((_total - 1) * {float(p)!r}D)" for p in probs]
    ranks = [(f"(floor({x}) + 1)", f"(ceil({x}) + 1)") for x in place]
    wanted = " or ".join(f"({rank} > _offset and {rank} <= _upto)" for pair in ranks for rank in pair)
    needed = sizes.where(wanted).select(*group, "_block", "_total", "_offset")
    ranked = lookup_join(blocks, needed, [*group, "_block"], how="inner", null_safe=True).selectExpr(
        "*", f"_offset + sum(_n) over (partition by {names}, _block order by value, _gap) as _upto"
    )
    found = [
        F.expr(f"min(if(_upto >= {rank}, struct(value, _gap), null)) as _{side}{i}")
        for i, pair in enumerate(ranks)
        for side, rank in zip(("lo", "hi"), pair)
    ]
    result = ranked.groupBy(*group, "_total").agg(*found)
    between = [
        f"_lo{i}.value + (_hi{i}.value - _lo{i}.value) * ({place[i]} - ({ranks[i][0]} - 1)) as q{i}" for i in range(len(probs))
    ]
    missed = " or ".join(f"_lo{i}._gap or _hi{i}._gap" for i in range(len(probs)))
    return result.selectExpr(*group, *between, f"{missed} as _missed")
