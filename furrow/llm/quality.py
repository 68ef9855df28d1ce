"""Quality rules: base rules and robust outliers by minimum covariance determinants.

Per document some statistics are made and transformed to a vector. Per language and source the
mean and covariance of the ``share`` of rows that make the covariance smallest are found by
concentration steps over all rows: distances, the quantile of the distances, new moments of the
rows below it, until no group's determinant falls any more. With half of the rows inside, up to
half of a group may be bad. Every step is a few aggregates in Spark; a group is only ever seen as its moments,
so a source with a third of all rows is summed like any other. Afterwards the usual reweighting
follows, and rows whose squared Mahalanobis distance is over the chi-square quantile are rejected.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.texts import blobs, map_batches, staged, table, windows

SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]
WINDOW = 5
FEATURES = ["log_words", "log_word_chars", "symbol_rate", "dup_line_rate", "repeat_rate"]
#: Least standard deviation per feature: where most rows are equal (no symbol, no repeated line),
#: a single symbol is not an outlier.
FLOORS = [0.5, 0.1, 0.1, 0.15, 0.15]
SHARE = 0.5
#: A group goes on while the log of its determinant falls by more than this; the floors bound it from below.
FALLS = 1e-4
REWEIGHT = 0.975
CUTOFF = 0.99999
#: Smaller groups are pooled by language, and what is still small, as a whole.
LEAST_ROWS = 100
#: Rows of a group are joined with its estimates in so many parts: fewer copies than a group has rows.
PARTS = 32
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20


def statistics(text: bytes) -> tuple[int, int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated windows, lines."""
    words = text.split()
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    duplicates = 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                duplicates += bool(line.split())
            seen.add(line)
    return (
        len(words),
        len(b"".join(words).decode()),
        sum(map(text.count, SYMBOLS)),
        duplicates,
        repeated_words(words),
        len(lines),
    )


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words which the text has twice or more."""
    found = windows(words, size)
    if len(set(found)) == len(found):
        return 0
    counts = Counter(found)
    total = covered = 0
    for at, window in enumerate(found):
        if counts[window] > 1:
            total += at + size - max(covered, at)
            covered = at + size
    return total


def chi_square(x: float, d: int) -> float:
    """Distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = d / 2, x / 2
    if half > 200 + 10 * a:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 10.0 * d + 200.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, d) < p else (low, middle)
    return high


def consistency(share: float, d: int) -> float:
    """What the covariance of the inner ``share`` of normal rows is multiplied by."""
    return share / chi_square(chi_square_quantile(share, d), d + 2)


def measured_rows(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None
) -> DataFrame:
    """``row`` (the columns ``carry`` of ``docs``, or all), its statistics, ``base_failed`` and the transformed vector ``x``.

    A null text counts as empty.
    """
    schema = [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [list(x) for x in zip(*map(statistics, blobs(batch, "text")))]
        fields = [("row", batch.schema.field(0).type), ("lang", pa.string()), ("source", pa.string()), *schema]
        return table(fields, batch.column(0), batch.column(2), batch.column(3), *made)

    ready = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"),
        F.col(f"`{text}`").cast("string").alias("text"),
        F.col(f"`{lang}`").cast("string").alias("lang"),
        F.col(f"`{source}`").cast("string").alias("source"),
    )
    kind = ready.schema["row"].dataType.simpleString()
    made = map_batches(ready, each, f"row {kind}, lang string, source string, " + ", ".join(f"{n} long" for n, _ in schema))
    words = F.greatest(F.col("n_words"), F.lit(1))
    x = F.array(
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    return made.withColumn("base_failed", failed).withColumn("x", x)


def grouped(rows: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Adds ``grp``: language and source, or the language's small sources together, or all that is left.

    Sizes are counted on ``docs (lang, source)``, the rows before their texts were read.
    """
    own = F.to_json(F.struct("lang", "source")).alias("_own")
    pooled = F.to_json(F.struct("lang", F.lit(True).alias("pooled"))).alias("_pool")
    keyed = rows.select("*", own)
    counts = docs.select(own, pooled).groupBy("_own", "_pool").agg(F.count("*").alias("n"))
    small = counts.where(F.col("n") < least)
    enough = small.groupBy("_pool").agg((F.sum("n") >= least).alias("enough"))
    moved = small.join(enough, "_pool").select("_own", F.when(F.col("enough"), F.col("_pool")).otherwise("{}").alias("grp"))
    joined = keyed.join(moved, "_own", "left")
    return joined.withColumn("grp", F.coalesce("grp", "_own")).drop("_own")


def in_parts(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """Rows with a part of their group, fixed once they are written."""
    return rows.withColumn("part", F.floor(F.rand(7) * parts).cast("int"))


def with_group(rows: DataFrame, groups: DataFrame, how: str = "inner", parts: int = PARTS) -> DataFrame:
    """Every row with its group's row; a group of very many rows is joined in ``parts`` tasks."""
    copies = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.join(copies, ["grp", "part"], how)


def squared_distance(d: int) -> Column:
    """Mahalanobis distance of ``x`` from ``mean`` under ``inverse`` (row by row)."""
    apart = [F.col("x")[i] - F.col("mean")[i] for i in range(d)]
    terms = [F.col("inverse")[i * d + j] * apart[i] * apart[j] for i in range(d) for j in range(d)]
    return reduce(Column.__add__, terms)


def moments(rows: DataFrame, d: int) -> DataFrame:
    """Per group: number of rows, sums and sums of products of ``x - centre``."""
    apart = [F.col("x")[i] - F.col("centre")[i] for i in range(d)]
    sums = F.array(*[F.sum(a) for a in apart])
    products = F.array(*[F.sum(apart[i] * apart[j]) for i in range(d) for j in range(d)])
    return rows.groupBy("grp").agg(
        F.first("centre").alias("centre"), F.count("*").alias("n"), sums.alias("sums"), products.alias("products")
    )


def estimates(found: DataFrame, d: int, factor: float, floors: list[float]) -> DataFrame:
    """``grp, centre, mean, inverse, determinant`` (its log): inverse covariances, with the floors on the diagonal."""
    schema = [("grp", pa.string()), ("centre", pa.list_(pa.float64())), ("mean", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("determinant", pa.float64())]
    least = np.diag(np.square(floors))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        means, inverses, determinants = [], [], []
        for row in batch.to_pylist():
            shift = np.array(row["sums"]) / row["n"]
            spread = np.array(row["products"]).reshape(d, d) / row["n"] - np.outer(shift, shift)
            means.append((np.array(row["centre"]) + shift).tolist())
            inverses.append(np.linalg.inv(factor * spread + least).ravel().tolist())
            determinants.append(np.linalg.slogdet(factor * spread + least)[1])
        return table(schema, batch.column(0), batch.column(1), means, inverses, determinants)

    return staged(map_batches(found, each, "grp string, centre array<double>, mean array<double>, inverse array<double>, determinant double"), "estimates")


def lower(current: DataFrame, found: DataFrame) -> DataFrame:
    """The new estimates of the groups whose determinant falls; the others stay as they are."""
    values = ["mean", "inverse", "determinant"]
    both = current.join(found.select("grp", *[F.col(v).alias(f"_{v}") for v in values]), "grp", "left")
    falls = F.coalesce(F.col("_determinant") < F.col("determinant") - FALLS, F.lit(False))
    return staged(both.select("grp", "centre", *[F.when(falls, F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values], falls.alias("falls")), "estimates")


def covariance_determinants(
    rows: DataFrame, floors: list[float] = FLOORS, share: float = SHARE, reweight: float = REWEIGHT
) -> DataFrame:
    """``grp, mean, inverse, determinant`` from rows ``grp, part, x``: robust estimates per group.

    Starts from medians and absolute deviations, so it is deterministic. Quantiles are Spark's
    approximate ones; ties at the quantile are inside. A group of a few rows rests on the floors.
    """
    d = len(floors)
    middle = rows.groupBy("grp").agg(F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(d)]).alias("centre"))
    away = with_group(rows, middle)
    wide = [F.percentile_approx(F.abs(F.col("x")[i] - F.col("centre")[i]), 0.5, 1000) for i in range(d)]
    start = away.groupBy("grp").agg(F.first("centre").alias("centre"), F.array(*wide).alias("wide"))
    diagonal = [
        (1 / (F.pow(1.4826 * F.col("wide")[i], 2) + floors[i] ** 2)) if i == j else F.lit(0.0) for i in range(d) for j in range(d)
    ]
    first = start.select(
        "grp", "centre", F.col("centre").alias("mean"), F.array(*diagonal).alias("inverse"), F.lit(math.inf).alias("determinant"), F.lit(True).alias("falls")
    )
    current = staged(first, "estimates")
    while current.where("falls").limit(1).count():
        moving = current.where("falls").select("grp", "centre", "mean", "inverse")
        far = with_group(rows, moving).withColumn("far", squared_distance(d))
        edge = far.groupBy("grp").agg(F.percentile_approx("far", share, 1000).alias("edge"))
        inner = with_group(rows, moving.join(edge, "grp")).where(squared_distance(d) <= F.col("edge"))
        current = lower(current, estimates(moments(inner, d), d, consistency(share, d), floors))
    near = with_group(rows, current).where(squared_distance(d) <= chi_square_quantile(reweight, d))
    return estimates(moments(near, d), d, consistency(reweight, d), floors)


def quality_rules(
    docs: DataFrame,
    cutoff: float = CUTOFF,
    least_rows: int = LEAST_ROWS,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    carry: list[str] | None = None,
) -> DataFrame:
    """``row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, far, kept``.

    ``row`` holds the columns ``carry`` of ``docs``, by default all, whatever their names. Estimates come from all rows that
    pass the base rules; equal rows count as often as they are there. Null languages and sources
    are groups of their own. ``far`` is null and ``kept`` false where the base rules fail. An empty
    table gives an empty result.
    """
    d = len(FEATURES)
    keys = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"))
    rows = staged(in_parts(grouped(measured_rows(docs, text, lang, source, carry), keys, least_rows)), "statistics")
    passed = rows.where("not base_failed").select("grp", "part", "x")
    found = covariance_determinants(passed).select("grp", "mean", "inverse")
    judged = with_group(rows, found, "left").withColumn("far", F.when(~F.col("base_failed"), squared_distance(d)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("far") <= chi_square_quantile(cutoff, d), F.lit(True))
    return judged.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "far", kept.alias("kept")
    )
