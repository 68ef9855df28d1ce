"""Semicolon files of the statistics office: preamble, quotes, mixed encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.scalars import stripped
from furrow.operators.joins import lookup_join

YEARS = ["2020", "2021", "2022", "2023", "2024"]
PRODUCTION_FIELDS = ["kind", "season", "crop", "location", *YEARS]
PRICE_FIELDS = ["metric", "region_level", "crop", "month", *YEARS]
SEASON_PRODUCTION_FIELDS = ["metric", "season", "crop", "location", "value_2024"]
SEASON_PRICE_FIELDS = ["metric", "region_level", "crop", "month", "price_2024"]


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Decoded lines of many files, in parallel: (file, line_no, line).

    ``line_no`` is the place in the file (block, then line), comparable within one file. A
    file with any line that is not UTF-8 is read as Latin-1 throughout. Only the names of
    such files are joined back.
    """
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("line_no"),
        F.col("value"),
    )
    latin = raw.where(~F.is_valid_utf8("value")).select("file").distinct().withColumn("_latin", F.lit(True))
    text = F.when(F.col("_latin"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value"))
    return lookup_join(raw, latin, ["file"]).select("file", "line_no", F.regexp_replace(text, "^\\uFEFF", "").alias("line"))


def _placed(lines: DataFrame, fields: Sequence[str], delimiter: str) -> DataFrame:
    """Lines with text, and the place ``start`` of their file's first line with all fields (null: none)."""
    filled = lines.where(F.trim("line") != "")
    wide = F.size(F.split("line", f"\\Q{delimiter}\\E")) >= len(fields)
    headers = filled.where(wide).groupBy("file").agg(F.min("line_no").alias("start"))
    return lookup_join(filled, headers, ["file"])


def read_table(
    spark: SparkSession, paths: str | Sequence[str], fields: Sequence[str], delimiter: str = ";", strict: bool = True
) -> DataFrame:
    """Data lines as text columns: (line_no, *fields).

    A file's data begin with its first line that has all fields; if that line's crop is the word
    "crop", it is the header. Every filled line after it is data. Fields that a line lacks are
    null, extra ones (a trailing delimiter) are dropped. With ``strict``
    a set of files without any data line is an error.
    """
    lines = _placed(read_lines(spark, paths), fields, delimiter).where(F.col("line_no") >= F.col("start"))
    ddl = ", ".join(f"`{f}` string" for f in [*fields, "_rest"])
    parsed = F.from_csv("line", ddl, {"sep": delimiter, "mode": "PERMISSIVE"})
    rows = lines.select("line_no", (F.col("line_no") == F.col("start")).alias("_first"), parsed.alias("r"))
    heading = F.col("_first") & F.coalesce(F.lower(stripped(F.col("r.crop"))) == "crop", F.lit(False))
    rows = rows.where(~heading).select("line_no", "r.*").drop("_rest")
    if strict and rows.isEmpty():
        raise ValueError(f"no line with {len(fields)} fields, separated by {delimiter!r}, in {paths}")
    return rows


def skipped_lines(spark: SparkSession, paths: str | Sequence[str], fields: Sequence[str], delimiter: str = ";") -> DataFrame:
    """(file, lines): filled lines that ``read_table`` takes for preamble, or all of a file without a full line."""
    before = _placed(read_lines(spark, paths), fields, delimiter).where(F.col("start").isNull() | (F.col("line_no") < F.col("start")))
    return before.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
