"""The filter audit against plain Python over every order."""

import re
from itertools import permutations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """``{(part, order, step): counts}`` from ``doc_id, text, lang`` rows."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    failed = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A"} if len(words) < 200 else set()
        bad |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        bad |= {"E"} if i is not None and first[text] < i else set()
        failed.append((lang or "", bad, i in good, i in toxic))
    made, whole = {}, {}
    for part in {f[0] for f in failed}:
        own = [f for f in failed if f[0] == part]
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [f for f in own if letter in f[1] and not f[1] & before]
                whole[part, letter] = whole.get((part, letter), 0) + len(here)
                made[part, "".join(order), step] = (
                    sum(not f[1] & (before | {letter}) for f in own), len(here), sum(letter in f[1] and bool(f[1] & before) for f in own),
                    sum(f[1] == {letter} for f in own), sum(f[2] for f in here), sum(f[3] for f in here),
                )
    return {k: (*v, whole[k[0], k[1][k[2] - 1]]) for k, v in made.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def test_audit_against_brute_force(spark, corpus):
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 60)] + [(3, 1, None), (3, None, 1), (None, 1, 1), (900, 1, None)]
    found = filter_audit.audit(corpus, spark.createDataFrame(labels, LABELS))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in corpus.collect()]
    assert audited(found) == brute(rows, labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_a_large_group_in_sub_groups(spark):
    rows = [(i, "the same text " * 80, "a") for i in range(300)] + [(i, f"other {i} text", "a") for i in range(300, 320)] + [(None, "the same text " * 80, "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = filter_audit.orders(filter_audit.combinations(docs, spark.createDataFrame([], LABELS), group_rows=7))
    assert audited(found) == brute(rows, [])


def test_equal_hashes_of_other_texts_are_no_copies(spark):
    rows = [(1, "x", "a", 5, 1), (2, "y", "a", 5, 1), (3, "x", "a", 5, 1), (4, "y", "b", 5, 1), (5, "z", "b", 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, hash long, size int")
    assert sorted(r["doc_id"] for r in filter_audit.copies(docs, docs.drop("text")).collect()) == [3, 4]


def test_audit_of_no_rows(spark, no_rows):
    assert filter_audit.audit(no_rows, spark.createDataFrame([], LABELS)).collect() == []


def test_only_symbols_and_blanks(spark):
    rows = [(1, "", "a"), (2, " \n\t ", "a"), (3, "#", "a"), (4, "É" * 10 + " A", "a"), (5, "\x0b\x0cAAA\x1cB", None), (6, "x " * 200, "a")]
    found = filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS))
    assert audited(found) == brute(rows, [])
    assert set(T.StructType(found.schema).fieldNames()) >= {"part", "shapley"}
    assert found.where(F.col("kept") < 0).count() == 0
