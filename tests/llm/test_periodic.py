"""Periodic runs against a scan of every period, and the query against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least, power):
    """Every stretch of equal words q apart, for each q; the smallest q of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, power * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def found(ids, least, power):
    return [tuple(r) for r in periodic.find_runs(np.array(ids, np.int32), least, power).tolist()]


def repetitive(seed):
    draw = random.Random(seed)
    n, letters = draw.randint(0, 300), draw.choice([1, 2, 3, 8, 60])
    ids = [draw.randint(1, letters) for _ in range(n)]
    for _ in range(draw.randint(0, 4) if n else 0):
        a, p = draw.randrange(n), draw.randint(1, 50)
        for i in range(a, min(n, a + draw.randint(5, 250))):
            ids[i] = ids[a + (i - a) % p]
    return ids


@pytest.mark.parametrize("least, power", [(24, 3), (2, 2), (5, 2), (1, 4)])
def test_runs_against_brute_force(least, power):
    for seed in range(250):
        ids = repetitive(seed)
        assert found(ids, least, power) == brute(ids, least, power)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=120))
def test_runs_of_any_words(ids):
    assert found(ids, 4, 2) == brute(ids, 4, 2)


def test_extension_against_comparing(monkeypatch):
    draw = random.Random(5)
    for n in (1, 31, 40, 200, 1000):
        ids = np.array([1 + (i // 97) % 2 if draw.random() < 0.99 else 3 for i in range(n)], np.int32)
        asked = periodic.Extension(ids)
        i = np.array([draw.randrange(n) for _ in range(300)])
        j = np.array([draw.randrange(n) for _ in range(300)])
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        if not len(i):
            continue
        near, still = asked.near(i, j)
        if still.any():
            near[still] += asked.far(i[still] + near[still], j[still] + near[still])
        for a, b, common in zip(i.tolist(), j.tolist(), near.tolist()):
            true = 0
            while b + true < n and ids[a + true] == ids[b + true]:
                true += 1
            assert common == true


def test_grid_in_blocks_is_the_whole_grid(monkeypatch):
    n = (1 << 16) + 500
    whole = sorted(zip(*(x.tolist() for x in periodic._grid(1, n // 3, n, 24, 3))))
    monkeypatch.setattr(periodic, "BLOCK", 1 << 12)
    blocks = [pair for block in periodic.grid(n, 24, 3) for pair in zip(*(x.tolist() for x in block))]
    assert sorted(blocks) == whole


def test_a_long_text_with_a_long_run():
    draw = np.random.default_rng(3)
    ids = draw.integers(1, 30_000, 90_000).astype(np.int32)
    ids[1_000:81_000] = np.resize(ids[1_000:1_700], 80_000)
    while ids[81_000] == ids[80_300]:
        ids[81_000] += 1
    while ids[999] == ids[1_699]:
        ids[999] += 1
    assert found(ids, 24, 3) == [(1_000, 80_000, 700)]


def expected(doc_id, text):
    """The row of the query for one document."""
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, 24, 3)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def by_query(docs):
    texts = periodic.planted_periods(docs)
    return periodic.digest_columns(periodic.periodic_runs(texts, carry=["doc_id"]))


def test_query_against_plain_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    wanted = sorted(expected(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    result = queries.op12_periodic_runs(spark, data)
    assert result.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in result.collect()) == wanted
    assert sum(r[1] for r in wanted) > 0


def test_nulls_ties_and_odd_texts(spark):
    one, two = "a b c " * 10, "x y z " * 10
    texts = [None, "", " \n\t ", one + "- " + two, two + "\x1c " + one, "la " * 24, "la " * 23, "é 日 " * 20, "q " * 30_000, one, one]
    rows = [(i, t, "row") for i, t in enumerate(texts)] + [(2, "again " * 40, None), (None, "gone " * 40, None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = sorted((tuple(r) for r in by_query(docs).collect()), key=repr)
    # the brute scan of the longest text takes only period 1 into account: all its words are equal
    wanted = sorted((expected(i, t) for i, t, _ in rows if t is None or len(t) < 50_000), key=repr)
    assert [r for r in got if r[0] != 8] == wanted
    assert [r[1:5] for r in got if r[0] == 8] == [(1, 0, 30_000, 1)]


def test_operator_keeps_the_columns(spark, corpus):
    made = periodic.periodic_runs(corpus)
    assert made.schema["row"].dataType.fieldNames() == corpus.columns
    assert made.count() == corpus.count()


def test_no_rows(spark, no_rows):
    assert by_query(no_rows).collect() == []


def test_senseless_limits_are_refused(corpus):
    with pytest.raises(ValueError):
        periodic.periodic_runs(corpus, power=1)
