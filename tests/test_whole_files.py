"""Files read in one pass: encodings, headings, refused lines, and the same rows as the split reader."""

import pytest
from conftest import rows

from furrow.sources import government, whole_files
from furrow.sources.whole_files import HEADING, NO_TABLE, PREAMBLE, TOO_LARGE

FIELDS = government.SEASON_PRODUCTION_FIELDS
GOOD = 'Title\n"Kind";"Season";"Crop";"Level";"2024";\n"Area";"Summer";"Tomatoes; large";"Amman";"1,000";\n\n"Area";"Winter"\n"Area";"Summer";"Kale";"Balqa";"";"more";"cells"\n'


def names(df):
    return {(r.file.rsplit("/", 1)[-1], r.line_no): r.reason for r in df.collect()}


def test_every_line_gets_a_verdict(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿" + GOOD, encoding="utf-8")
    (tmp_path / "b.csv").write_bytes('"Area";"Summer";"Café";"Amman";7\r\n"x"\r\n'.encode("latin-1"))
    (tmp_path / "c.csv").write_text("nothing;here\n\nat all\n")
    (tmp_path / "d.csv").write_text("")
    data, refused = whole_files.read_files(spark, str(tmp_path), FIELDS)
    assert rows(data.drop("file")) == sorted([
        (2, "Area", "Summer", "Tomatoes; large", "Amman", "1,000"), (4, "Area", "Winter", None, None, None), (5, "Area", "Summer", "Kale", "Balqa", None),
        (0, "Area", "Summer", "Café", "Amman", "7"), (1, "x", None, None, None, None),
    ], key=lambda r: tuple((x is not None, x) for x in r))
    assert names(refused) == {("a.csv", 0): PREAMBLE, ("a.csv", 1): HEADING, ("c.csv", 0): NO_TABLE, ("c.csv", 2): NO_TABLE}


def test_the_same_rows_as_the_split_reader(spark, tmp_path):
    for i in range(5):
        lines = "".join(f'"Area";"Summer";"Crop {j}";"Amman";"{i},{j:03d}";\n' for j in range(50))
        (tmp_path / f"{i}.csv").write_text("Title\nSecond\n" + ('"Kind";"Season";"Crop";"Level";"2024"\n' if i % 2 else "") + lines)
    one, _ = whole_files.read_files(spark, str(tmp_path), FIELDS)
    two = government.read_table(spark, str(tmp_path), FIELDS)
    assert rows(one.select(*FIELDS)) == rows(two.select(*FIELDS)) and one.count() == 250


def test_a_file_beyond_the_limit_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whole_files, "MOST_BYTES", 100)
    (tmp_path / "small.csv").write_text('"Area";"Summer";"Kale";"Amman";7\n')
    (tmp_path / "large.csv").write_text(GOOD * 10)
    data, refused = whole_files.read_files(spark, str(tmp_path), FIELDS)
    assert data.count() == 1 and names(refused) == {("large.csv", 0): TOO_LARGE}


@pytest.mark.parametrize("lines", [1, 3])
def test_results_come_in_batches(spark, tmp_path, monkeypatch, lines):
    monkeypatch.setattr(whole_files, "LINES", lines)
    (tmp_path / "a.csv").write_text("".join(f"Area;Summer;c{i};Amman;{i}\n" for i in range(10)))
    assert whole_files.read_files(spark, str(tmp_path), FIELDS)[0].count() == 10
