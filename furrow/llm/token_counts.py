"""Token counts by a two-tier lookup on the map side; no pre-token of the corpus is shuffled.

A pre-token here is a run without white space together with the blank before it, or white
space that belongs to no word. The byte-level tokenizer splits further, but never across
these, so the sum of their lengths is the length of the text. Texts with special strings or
rare white space go to the library as a whole.

A pre-token of letters alone, or of letters and marks after them, is one run or two of the model's
pattern and is merged by rank; every other goes to the library.

Tier one: every task keeps a bounded summary of its frequent pre-tokens; the summaries (not
the pre-tokens) are added up, the most frequent, at most ``table_size``, are encoded and broadcast.
It saves work and never changes a count. Tier two: a cache per worker for what was missed.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.byte_merges import merger
from furrow.llm.texts import column, kept_by_worker, keyed, map_batches, map_partition, most_frequent, shared_file, staged, table

PRE_TOKEN = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
#: White space and separators on which libraries may differ; such texts are encoded whole.
RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Marks that make one run of their own after letters, and letters on which all versions of Unicode agree.
MARKS = ".,;:!?*$%#&|()-"
LETTERS = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
TABLE_SIZE = 1 << 16
#: Longest pre-token, in characters, that the broadcast table and the caches keep.
KEPT_CHARS = 64
CACHE_SIZE = 400_000
SUMMARY_SIZE = 1 << 15

_workers: dict[int, Worker] = kept_by_worker(__name__)


def tokenizer(blob: bytes):
    """The library's tokenizer from the content of its file, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(blob.decode())
    made.no_truncation()
    made.no_padding()
    return made


def lengths(library, texts: list[str]) -> list[int]:
    return [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]


class Lengths:
    """Token counts of pre-tokens."""

    def __init__(self, vocabulary: bytes):
        self.library = tokenizer(vocabulary)
        file = json.loads(vocabulary)
        split = file["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        found = merger(vocabulary) if plain and not file["normalizer"] else None
        self.merge = found[0] if found and not found[1] else None

    def __call__(self, pre_tokens: list[str]) -> Iterator[tuple[str, int]]:
        """Every pre-token with its count, in any order."""
        merge, rest = self.merge, []
        if merge is None:
            rest = pre_tokens
        else:
            for x in pre_tokens:
                word = x.rstrip(MARKS)
                if LETTERS.fullmatch(word, x[0] == " "):
                    n = len(merge(word.encode()))
                    yield x, n if len(word) == len(x) else n + len(merge(x[len(word) :].encode()))
                else:
                    rest.append(x)
        if rest:
            yield from zip(rest, lengths(self.library, rest))


def frequent_lengths(docs: DataFrame, measure: Lengths, table_size: int = TABLE_SIZE) -> tuple[bytes, bytes]:
    """Frequent pre-tokens (joined by a zero byte) and their token counts (16 bits each)."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in column(batch, "text"):
                seen.update(PRE_TOKEN.findall(text or ""))
            if len(seen) > 8 * SUMMARY_SIZE:
                seen = Counter(dict(seen.most_common(SUMMARY_SIZE)))
        top = [(x, n) for x, n in seen.most_common(SUMMARY_SIZE) if len(x) <= KEPT_CHARS and n > 1 and "\0" not in x]
        if top:
            yield table([("pre", pa.string()), ("n", pa.int64())], *map(list, zip(*top)))

    summaries = map_partition(docs.select("text"), summary, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    counts = staged(summaries, "pre-tokens")
    found = counts.where(F.col("n") >= most_frequent(counts, table_size)).select("pre").orderBy("pre").collect()
    words = [row["pre"] for row in found]
    known = dict(measure(words))
    counts = np.minimum([known[x] for x in words], 65535).astype(np.uint16)
    return zlib.compress("\0".join(words).encode()), counts.tobytes()


def token_counts(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row.

    Null texts count as empty (0 tokens); repeated rows and null keys are kept as they are;
    other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    read = keyed(docs, key, text)
    vocabulary = shared_file(spark, tokenizer_path)
    frequent = spark.sparkContext.broadcast(frequent_lengths(read, Lengths(vocabulary.value)))
    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        worker = _worker(vocabulary, frequent)
        texts = [x or "" for x in column(batch, "text")]
        whole = [i for i, x in enumerate(texts) if RARE.search(x) or any(s in x for s in worker.special)]
        odd = dict(zip(whole, lengths(worker.library, [texts[i] for i in whole]))) if whole else {}
        parts = [[] if i in odd else PRE_TOKEN.findall(x) for i, x in enumerate(texts)]
        known = worker.cover(set().union(*parts))
        totals = [odd[i] if i in odd else sum(map(known.__getitem__, part)) for i, part in enumerate(parts)]
        worker.forget_long()
        return table(schema, batch.column(0), [len(x.encode()) for x in texts], totals, [n > limit for n in totals])

    ready = read.select(F.col("doc_id").cast("long"), "text")
    return map_batches(ready, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class Worker:
    """What one Python worker keeps between batches and tasks: the broadcast table and a bounded cache."""

    def __init__(self, vocabulary: bytes, words: bytes, counts: bytes):
        self.lengths = Lengths(vocabulary)
        self.library = self.lengths.library
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        text = zlib.decompress(words).decode()
        self.first = dict(zip(text.split("\0"), np.frombuffer(counts, np.uint16).tolist())) if counts else {}
        self.known = dict(self.first)
        self.long: list[str] = []

    def cover(self, asked: set[str]) -> dict[str, int]:
        """Lengths that include all of ``asked``."""
        if len(self.known) > CACHE_SIZE:
            self.known = dict(self.first)
        missed = list(asked.difference(self.known))
        if missed:
            self.known.update(self.lengths(missed))
            self.long = [x for x in missed if len(x) > KEPT_CHARS]
        return self.known

    def forget_long(self) -> None:
        for x in self.long:
            del self.known[x]
        self.long = []


def _worker(vocabulary, frequent) -> Worker:
    words, counts = frequent.value
    key = zlib.crc32(counts, zlib.crc32(words, zlib.crc32(vocabulary.value)))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Worker(vocabulary.value, words, counts)
    return _workers[key]
