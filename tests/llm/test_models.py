"""Language model and language identification: brute force, gradients and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from furrow.llm import language_id, lm_score

from .conftest import words


def is_held_out(key, parts, part):
    return key is not None and zlib.crc32(str(key).encode()) % parts == part


def brute_model(streams, order):
    """Counts of symbols after every context of up to ``order`` bytes."""
    found = {}
    for s in streams:
        for i in range(order, len(s)):
            for k in range(order + 1):
                found.setdefault(s[i - k : i], Counter())[s[i]] += 1
    return found


def brute_chances(model, context):
    """All 256 probabilities by escape and exclusion."""
    chance = np.full(256, 1 / 256)
    for k in range(len(context) + 1):
        seen = model.get(context[len(context) - k :])
        if not seen:
            continue
        total = sum(seen.values())
        rest = np.array([0.0 if s in seen else chance[s] for s in range(256)])
        chance = rest / rest.sum() * len(seen) / (2 * total)
        for s, n in seen.items():
            chance[s] = (2 * n - 1) / (2 * total)
    return chance


def test_scores(corpus, no_rows):
    made = lm_score.lm_scores(corpus, frequent=20).collect()
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in corpus.select("doc_id", "text").collect()]
    training = [w for k, w in rows if not is_held_out(k, 7, 2)]
    counts = Counter(x for w in training for x in [*w, b"END "])
    total, kinds = sum(counts.values()), len(counts)
    model = brute_model([lm_score.stream(w) for w in training], lm_score.ORDER)
    kept = {}

    def score(own):
        s, total = lm_score.stream(own), 0.0
        for i in range(lm_score.ORDER, len(s)):
            context = s[i - lm_score.ORDER : i]
            if context not in kept:
                kept[context] = np.log10(brute_chances(model, context))
            total += kept[context][s[i]]
        return total

    expected = Counter()
    for key, own in rows:
        base = sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in [*own, b"END "])
        known = sum(counts[x] > 0 for x in [*own, b"END "])
        long = len(own) > 5000
        expected[key, is_held_out(key, 7, 2), len(own) + 1, known, total, round(base, 6), 0 if long else round(score(own), 2)] += 1
    got = Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), 0 if r["n_tokens"] > 5000 else round(r["score"], 2))
        for r in made
    )
    assert got == expected
    assert lm_score.lm_scores(no_rows).count() == 0


def test_scores_do_not_depend_on_the_broadcast_contexts(spark):
    """Contexts that are not broadcast count as well: equal to brute force over all counts, held out or not."""
    texts = [words(i, 15, "abcdefghijkl" if i % 3 else "abc\u00e9\u65e5") for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    streams = [lm_score.stream(t.encode().split()) for t in texts]
    model = brute_model([s for i, s in enumerate(streams) if not is_held_out(i, 7, 2)], lm_score.ORDER)
    expected = [
        sum(np.log10(brute_chances(model, s[i - lm_score.ORDER : i])[s[i]]) for i in range(lm_score.ORDER, len(s))) for s in streams
    ]
    for contexts in (1, 30, 400):
        made = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(docs, contexts=contexts).collect()}
        assert np.allclose([made[i] for i in range(len(texts))], expected, rtol=1e-5)


def test_probabilities_sum_to_one():
    draw = random.Random(1)
    streams = [lm_score.stream(words(i, 20, "abc").encode().split()) for i in range(20)]
    keys, n = lm_score.run_counts(streams)
    columns = []
    for k in range(lm_score.ORDER + 1):
        own = Counter()
        for key, count in zip(keys.tolist(), n.tolist()):
            own[key >> 8 & (1 << 8 * k) - 1, key & 255] += count
        columns += sorted((k, c, s, v) for (c, s), v in own.items())
    model = lm_score.Model(*map(np.array, zip(*columns)))
    assert np.allclose((10.0 ** model.log10.astype(float)).sum(1), 1, atol=1e-4)
    both = [streams[0], streams[1]]
    assert np.allclose(model.scores(both), [model.scores([x])[0] for x in both])
    assert draw and lm_score.Model(*[np.zeros(0, np.int64)] * 4).scores([b"AAAAAabA"])[0] < -7


def test_training_without_documents(spark):
    held = [i for i in range(60) if is_held_out(i, 7, 2)]
    docs = spark.createDataFrame([(i, "some text") for i in held], "doc_id long, text string")
    for r in lm_score.lm_scores(docs).collect():
        assert (r["held_out"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 0, 0, 0.0)


def test_gradients():
    network = language_id.Network(["a", "b"], states=3, seed=1)
    for d in (network.ahead, network.behind):
        for name in ("rows", "weights", "bias"):
            setattr(d, name, getattr(d, name).astype(np.float64) * 0.3)
    network.out, network.base = network.out.astype(np.float64), network.base.astype(np.float64)
    data, there = language_id.layout([b"abcab", b"cb", b"aacbbca"])
    data, there, labels = data[:9], there[:9], np.array([0, 1, 1])
    _, found = network.gradients(data, there, labels)
    draw = np.random.default_rng(0)
    for p, g in zip(network.parameters(), found):
        for _ in range(4):
            at = tuple(draw.integers(0, s) for s in p.shape) if p.shape[0] != 256 else (int(draw.choice(data[:2].ravel())), int(draw.integers(p.shape[1])))
            before, step = p[at], 1e-3
            p[at] = before + step
            high = network.gradients(data, there, labels)[0]
            p[at] = before - step
            low = network.gradients(data, there, labels)[0]
            p[at] = before
            assert abs((high - low) / (2 * step) - g[at]) < 2e-3


def test_languages(corpus, no_rows):
    made = language_id.identify(corpus, carry=["doc_id", "text", "lang"]).collect()
    assert len(made) == corpus.count()
    assert all(0 <= r["score"] <= 1 for r in made)
    for r in made:
        text = r["row"]["text"]
        open_text = text is None or not any(c.isalpha() for c in text)
        assert (r["lang_pred"] == "und") == open_text
    assert language_id.identify(no_rows).count() == 0
    assert set(made[0]["row"].asDict()) == {"doc_id", "text", "lang"}


def test_held_out_accuracy(spark):
    rows = [(i, words(i, 30, "abcdefgh" if i % 2 else "efghijkl"), "x" if i % 2 else "y") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = language_id.identify(docs, carry=["doc_id", "lang"]).collect()
    held = [r for r in made if is_held_out(r["row"]["doc_id"], 5, 0)]
    assert len(held) > 50 and sum(r["lang_pred"] == r["row"]["lang"] for r in held) > 0.97 * len(held)


def test_windows_do_not_depend_on_the_batch():
    network = language_id.Network(["a", "b", "c"])
    texts = [b"short", b"x" * 128, words(1, 100).encode(), b"y" * 129]
    together = network.predict(texts)
    assert np.allclose(together, np.concatenate([network.predict([t]) for t in texts]), atol=1e-6)
    assert np.allclose(together.sum(1), 1, atol=1e-5)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(docs, carry=["doc_id"]).collect()} == {"und"}


def test_more_languages_than_the_network_holds_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    rows = [(i, "some text of its own " * 3, f"l{i % 4}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        language_id.training_windows(docs, 5)
    assert language_id.training_windows(docs.where("lang <> 'l3'"), 5)[0] == ["l0", "l1", "l2"]
