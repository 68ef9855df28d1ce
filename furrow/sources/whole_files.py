"""Statistics files in one pass: every file is read once, by one task, and every line gets a verdict.

For many files of moderate size (up to ``MOST_BYTES`` each, which Spark reads as one value). The task that has a
file finds its encoding, its first full line and its heading, and cuts the lines; lines that hold no data come
out with the reason. Larger files go through ``government.read_table``, whose lines are split over tasks.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import cut_lineage

MOST_BYTES = 256 * 1024 * 1024
#: Lines of one result batch.
LINES = 10_000
PREAMBLE, HEADING, TOO_LARGE, NO_TABLE = "before the table", "heading", "file too large", "no line with all fields"


def read_files(
    spark: SparkSession, paths: str | Sequence[str], fields: Sequence[str], delimiter: str = ";", heading: str = "crop"
) -> tuple[DataFrame, DataFrame]:
    """Data lines as text columns ``(file, line_no, *fields)`` and refused ones as ``(file, line_no, line, reason)``.

    A file that is not UTF-8 throughout is Latin-1; a byte order mark goes. Its table begins with the first
    line that has all fields, which is left out as the heading if its field ``heading`` is that word. Missing
    fields are null, as are empty ones; extra ones are dropped; lines without text are passed over.
    """
    names, many = list(fields), len(fields)
    place = names.index(heading) if heading in names else None
    found = spark.read.format("binaryFile").load(paths)
    files = found.where(F.col("length") <= MOST_BYTES).select(F.col("path").alias("file"), "content")
    large = found.where(F.col("length") > MOST_BYTES)  # only listed, not read
    columns = ["file", "line_no", "line", "reason", "fields"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]

    def verdicts(content: bytes) -> Iterator[tuple]:
        try:
            text = content.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = content.decode("latin-1")
        begun, before = False, []
        for number, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if not line.strip():
                continue
            cells = next(csv.reader([line], delimiter=delimiter, skipinitialspace=False, strict=False))
            if not begun and len(cells) < many:
                before.append((number, line))
                continue
            first, begun = not begun, True
            if first:
                yield from ((n, x, PREAMBLE, None) for n, x in before)
                if place is not None and cells[place].strip().lower() == heading:
                    yield number, line, HEADING, None
                    continue
            yield number, None, None, [x if x != "" else None for x in cells[:many]] + [None] * (many - len(cells))
        if not begun:
            yield from ((n, x, NO_TABLE, None) for n, x in before)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                held: list[tuple] = []
                for found in verdicts(content.as_py()):
                    held.append((file.as_py(), *found))
                    if len(held) == LINES:
                        yield packed(held)
                        held = []
                if held:
                    yield packed(held)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=columns)

    rows = files.mapInArrow(cut, "file string, line_no long, line string, reason string, fields array<string>")
    unread = large.selectExpr("path as file", "0L as line_no", "cast(null as string) as line", f"'{TOO_LARGE}' as reason", "cast(null as array<string>) as fields")
    made = cut_lineage(rows.unionByName(unread))
    data = made.where("reason IS NULL").select("file", "line_no", *[F.col("fields")[i].alias(n) for i, n in enumerate(names)])
    return data, made.where("reason IS NOT NULL").select("file", "line_no", "line", "reason")
