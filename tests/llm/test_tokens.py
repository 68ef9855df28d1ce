"""Operators on tokens against the libraries themselves."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from furrow.llm import byte_merges, packing, pieces, texts, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a  b ", "a\n\n b\t c \n", "x <|endoftext|> y", "  <|endoftext|>", "<|ENDOFTEXT|>a", "don't WE'LL 's", "ﬁ ½ ² 日本語 😀",
    "e\u0301 H\u0331 \u0130", "a\u00a0b\u2003c\u200bd", "\x1c\x00\x85", "\u2581x \u2581\u2581", "<s> <0x41>", "123 4567", "a" * 300,
]


def noise(count):
    draw = random.Random(3)
    letters = list("abcdeXYZ .,'|\n\t  12") + ["é", "ß", "日", "😀", "tion", "the ", "\u2581", "    "]
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(count)]


def test_transducer_equals_library():
    made, library = pieces.Transducer(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ODD + noise(500):
        ids = np.frombuffer(made.encode(text), "<i4").tolist()
        assert ids == library.encode(text), text
        assert made.decode(ids) == library.decode(ids), text
    assert made.decode([3 + 0xFF, 3 + 0x41]) == library.decode([3 + 0xFF, 3 + 0x41])


def test_unigram_path_is_the_least():
    """Every segmentation of a short text is tried."""
    made = pieces.Transducer(open(MODEL, "rb").read())
    made.merges = False
    text = "\u2581within"

    def least(rest):
        options = [(-made.scores[made.piece[rest[:n]]] + least(rest[n:])) for n in range(1, len(rest) + 1) if rest[:n] in made.piece]
        return min(options) if rest else 0.0

    assert sum(-made.scores[made.piece[p]] for p in made.path(text)) == least(text)


def test_encoding_round_trip(corpus, no_rows):
    rows = pieces.round_trip(pieces.encode(corpus, MODEL), MODEL).collect()
    assert len(rows) == corpus.count() and all(r["round_trip"] for r in rows)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = sorted(zlib.crc32(np.array(library.encode(r["text"] or ""), "<u4").tobytes()) for r in corpus.collect())
    assert sorted(r["ids_crc32"] for r in rows) == expected
    assert pieces.decode(pieces.encode(no_rows, MODEL), MODEL).count() == 0


def test_token_counts(spark, corpus, no_rows):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD + noise(200))], "doc_id long, text string")
    library = Tokenizer.from_file(BYTES)
    for docs in (corpus, odd):
        made = token_counts.token_counts(docs, BYTES, limit=50).collect()
        expected = [(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()]
        key = lambda r: (r[0] is None, r)
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in made), key=key) == sorted(expected, key=key)
        assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in made)
    assert token_counts.token_counts(no_rows, BYTES).count() == 0


def test_word_ids_equal_library():
    blob = open(WORDS, "rb").read()
    cache = packing.Ids(blob)
    for text in ODD + noise(500):
        found = text.encode().split()
        ids = np.frombuffer(b"".join(map(cache.__getitem__, found)), "<u4").tolist()
        assert ids == cache.library.encode(text, add_special_tokens=False).ids, text


def test_merging_by_rank_equals_library():
    for path in (WORDS, BYTES):
        blob = open(path, "rb").read()
        merge, end = byte_merges.merger(blob)
        library = Tokenizer.from_file(path)
        library.normalizer = None
        table, _ = byte_merges.ranks(blob)
        runs = [x.removesuffix(end) if end else x for x in table]
        for run in [x for x in runs if x]:
            try:
                text = run.decode()
            except UnicodeDecodeError:
                continue
            if len(library.pre_tokenizer.pre_tokenize_str(text)) == 1:
                assert merge(run + end) == library.encode(text, add_special_tokens=False).ids, text


def test_models_without_ranks_go_to_the_library():
    file = json.loads(open(WORDS, "rb").read())
    file["model"]["merges"][0], file["model"]["merges"][1] = file["model"]["merges"][1], file["model"]["merges"][0]
    blob = json.dumps(file).encode()
    assert byte_merges.merger(blob) is None
    cache = packing.Ids(blob)
    text = "The thin thing's in 12 an\u00e9 x,, " + "ab" * 60
    assert np.frombuffer(b"".join(map(cache.__getitem__, text.encode().split())), "<u4").tolist() == cache.library.encode(text, add_special_tokens=False).ids


def test_caches_of_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_SIZE", 50)
    monkeypatch.setattr(packing, "RUN_CACHE_SIZE", 20)
    cache = packing.Ids(open(WORDS, "rb").read())
    for text in noise(100) + ["x" * 100 + " y" * 3]:
        found = text.encode().split()
        assert np.frombuffer(b"".join(map(cache.__getitem__, found)), "<u4").tolist() == cache.library.encode(text, add_special_tokens=False).ids
        assert len(cache) <= 50 and len(cache.runs) <= 20
    assert b"x" * 100 not in cache and b"x" * 100 not in cache.runs


@pytest.mark.parametrize("limit", [2048, 64])
def test_packing(corpus, no_rows, limit):
    rows = packing.pack(corpus, WORDS, limit=limit).collect()
    library = Tokenizer.from_file(WORDS)
    ids = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in corpus.collect()]
    expected = sorted(
        (d is None, d or 0, start // limit, start, len(x[start : start + limit]), zlib.crc32(np.array(x[start : start + limit], "<u4").tobytes()))
        for d, x in ids
        for start in range(0, len(x), limit)
    )
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3], r[4]) for r in rows) == expected
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= limit
    total = sum(len(x) for _, x in ids)
    assert len(ends) <= 1.1 * total / limit + 2
    assert packing.pack(no_rows, WORDS).count() == 0


def test_nonnegative_fit_is_optimal():
    draw = np.random.default_rng(2)
    a, b = draw.integers(0, 3, (12, 60)).astype(float), draw.random(12)
    x = packing.nonnegative_fit(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 0]).max() < 1e-6


def test_plan_holds_every_piece_once():
    draw = random.Random(4)
    histogram = {draw.randint(1, 2048): draw.randint(1, 400) for _ in range(500)} | {2048: 1000}
    plan = packing.make_plan(histogram, 2048)
    found = {}
    for lengths, count in plan.groups:
        assert sum(lengths) <= 2048
        for n in lengths:
            found[n] = found.get(n, 0) + count
    assert {n: c for n, c in found.items() if c} == histogram
    bound = sum(n * c for n, c in histogram.items()) / 2048
    assert sum(c for _, c in plan.groups) <= 1.04 * bound + 2


def test_a_worker_keeps_the_tables_of_one_operator(spark):
    """What packing keeps goes when another operator comes to the worker."""
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    assert packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048).agg({"ids_crc32": "max"}).first()[0] > 0

    def each(batch):
        return pa.RecordBatch.from_pydict({"tables": [len(packing._workers) + len(token_counts._workers)]})

    assert {r["tables"] for r in texts.map_batches(docs, each, "tables long").collect()} == {0}

    def own(batch):
        packing._workers[1] = None
        texts.forget_others(packing.__name__)
        return pa.RecordBatch.from_pydict({"tables": [len(packing._workers)]})

    assert {r["tables"] for r in texts.map_batches(docs, own, "tables long").collect()} == {1}
