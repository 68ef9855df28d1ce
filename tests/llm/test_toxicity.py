"""Toxicity: features and cover against plain Python, held-out accuracy, odd inputs."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from furrow.llm import queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def clean(draw, n=60):
    return " ".join("".join(draw.choice("aeioumnrst") for _ in range(draw.randint(2, 8))) for _ in range(n))


def sample(count=400, seed=4):
    """Every fifth text holds made-up insults, some of them hidden or with endings."""
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(count):
        words, toxic = clean(draw).split(), int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(["zwackel", "grumpf", "Zwackelo", "grumpf!!", "zw4ckel", "grummmpfig", "you grumpf"])
        rows.append((i, " ".join(words), "a", "s"))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame(labels, LABELS), labels, toxicity.learn(docs, spark.createDataFrame(labels, LABELS))


def test_folding():
    assert toxicity.folded("Idiot,") == ("idiot", False, False)
    assert toxicity.folded("1d10t") == ("idiot", True, False)
    assert toxicity.folded("i.d.i.o.t") == ("idiot", True, False)
    assert toxicity.folded("stuuuupid!") == ("stupid", False, True)
    assert toxicity.folded("don't") == ("dont", False, False)
    assert toxicity.folded("2024") == ("2024", False, False)
    assert toxicity.folded("%%%") == ("", False, False)


def test_features_against_plain_python():
    draw = random.Random(8)
    vocabulary = ["grumpf", "grumpfen", "you", "DU", "idiot", "1d!ot", "nice", "Sooo", "WOW!", "why?", "a-b", "7", "#x", "été"]
    describer = toxicity.Describer(["grump", "so$"])
    for n in (0, 1, 5, 200):
        text = " ".join(draw.choice(vocabulary) for _ in range(n))
        words, size = text.split(), max(len(text.encode()), 1)
        cores = [toxicity.folded(w) for w in words]
        learned = [c.startswith("grump") or c == "so" for c, _, _ in cores]
        insult = [c in toxicity.INSULTS for c, _, _ in cores]
        you = [i for i, (c, _, _) in enumerate(cores) if c in toxicity.YOU]
        hits = [i for i in range(n) if learned[i] or insult[i]]
        near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in hits)
        letters = max(len(re.findall("[A-Za-z]", text)), 1)
        per, signs = 100 / max(n, 1), lambda x: 100 * sum(text.count(c) for c in x) / size
        wanted = [
            per * sum(learned), len({c[:5] if c != "so" else c for (c, _, _), x in zip(cores, learned) if x}), per * sum(insult), per * near,
            near / max(len(hits), 1), per * len(you), 100 * len(re.findall("[A-Z]", text)) / letters, per * sum(len(c) > 1 and w.isupper() for w, (c, _, _) in zip(words, cores)),
            signs("!"), signs("?"), signs(".,;:'\"()-"), signs("#$%&*|<>@^~"), signs("0123456789"), per * sum(h for _, h, _ in cores),
            per * sum(cores[i][1] for i in hits), per * sum(s for _, _, s in cores), None,
        ]
        for _ in range(2):  # the second time from the cache
            found = describer.describe(text.encode())
            assert len(found) == len(toxicity.FEATURES)
            assert found[:-1] == pytest.approx(wanted[:-1])


def test_cover_takes_what_explains_open_texts():
    names = ["idio", "idiot", "idiot$", "scum", "family$"]
    found = [[0, 1, 2], [0, 1, 2, 3], [0, 1, 2, 3], [3], [3, 4], [0, 1, 2, 3, 4], [0, 1, 2, 3, 4]]
    assert toxicity.chosen(names, [0] * 5, found, 3) == ["idiot", "scum"]
    assert toxicity.chosen(names, [0] * 5, found, 1) == ["family$", "idiot", "scum"]
    assert toxicity.chosen([], [], [], 1) == []


def test_held_out_accuracy(spark, learned):
    docs, _, labels, model = learned
    assert any("zwackel".startswith(e) for e in model.lexicon) and any("grumpf".startswith(e) for e in model.lexicon)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, carry=["doc_id"]).select("row.doc_id", "score").collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((scores[i] >= 0.5) == bool(t) for i, t in held)
    assert len(held) > 50 and right >= 0.97 * len(held)
    assert all(0 <= x <= 1 for x in scores.values())


def test_labels_of_held_out_documents_change_nothing(spark, learned):
    docs, labels, _, model = learned
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.learn(docs.withColumn("lang", F.lit("z")), other)
    one, two = ({r["row"]["doc_id"]: r["score"] for r in toxicity.score(docs, m, carry=["doc_id"]).collect()} for m in (model, again))
    assert model.lexicon == again.lexicon and one == two


def test_sample_is_bounded_and_weighted(spark, learned):
    docs, labels, rows, _ = learned
    taught = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows)
    few = toxicity.training_texts(docs, labels, per_label=40).collect()
    assert len(few) < 120 and sum(r["weight"] for r in few) == pytest.approx(taught, rel=0.35)
    every = toxicity.training_texts(docs.union(docs).union(docs), labels.union(labels)).collect()
    assert len(every) == taught and sum(r["weight"] for r in every) == taught


def test_odd_texts_and_columns(spark, corpus, learned):
    model = learned[3]
    found = toxicity.score(corpus, model)
    assert found.schema["row"].dataType.fieldNames() == corpus.columns
    rows = found.collect()
    assert len(rows) == corpus.count()
    by_text = {}
    for r in rows:
        by_text.setdefault(r["row"]["text"] or "", set()).add(r["score"])
    assert all(len(x) == 1 for x in by_text.values())


def test_no_rows_and_no_labels(spark, no_rows, corpus):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score(no_rows, toxicity.learn(no_rows, none)).collect() == []
    assert {r["score"] for r in toxicity.score(corpus, toxicity.learn(corpus, none)).collect()} == {0.0}
    some = spark.createDataFrame([(i, 1, 1) for i in range(60)] + [(None, 1, 0), (1, 1, None)], LABELS)
    assert {r["score"] for r in toxicity.score(corpus, toxicity.learn(corpus, some)).collect()} == {1.0}


def test_query(spark, data):
    found = queries.op11_toxicity(spark, data)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
