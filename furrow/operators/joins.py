"""Left and inner lookups that stay balanced when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import cut_lineage, measured

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    known_bytes: int | None = None,
) -> DataFrame:
    """Join ``facts`` to ``lookup`` on equal column names, keeping the key of ``facts``.

    The lookup is computed once and its size is read from that same job. Up to
    ``max_bytes`` it is broadcast, so the facts are not shuffled at all. Beyond, the rows
    of hot keys are spread over ``salts`` sub-keys and their lookups repeated once per
    sub-key, so a key with a third of all rows becomes many small tasks. A lookup that
    was measured before (or is part of one) is passed with ``known_bytes``.
    """
    stored, size = (lookup, known_bytes) if known_bytes is not None else measured(lookup)
    if size <= max_bytes:
        return keyed_join(facts, F.broadcast(stored), keys, how, null_safe)
    return salted_join(facts, stored, keys, how, null_safe, salts)


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
    salts: int = SALTS,
) -> DataFrame:
    """Only hot keys get sub-keys; the rows and lookups of all others are joined as they are.

    A key is hot with more than ``1 / (8 * salts)`` of the rows, so there are fewer than ``8 * salts``
    hot keys and their list is broadcast. The sub-key of a row depends on its partition and
    content, so a retry repeats it.
    """
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"))
    hot = one_row(counts, rows).where(F.col("_n") * 8 * salts > F.col("_all")).select(*keys, F.lit(True).alias("_hot"))
    hot = cut_lineage(hot)
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in _hashable(facts)]), F.lit(salts)).cast("int")
    marked = keyed_join(facts, F.broadcast(hot), keys, "left", null_safe)
    salted = marked.withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    last = F.when(F.col("_hot"), salts - 1).otherwise(0)
    copies = keyed_join(lookup, F.broadcast(hot), keys, "left", null_safe)
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    return keyed_join(salted, copies, [*keys, "_salt"], how, null_safe).drop("_salt")


def keyed_join(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    if not null_safe:
        return facts.join(lookup, list(keys), how)
    renamed = lookup.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return facts.join(renamed, match, how).drop(*[f"_key_{k}" for k in keys])


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (size proven by construction)."""
    return df.crossJoin(F.broadcast(row))
