"""Pattern packing: few-document length patterns, repeat counts by non-negative least squares, best fit for the rest.

Only the histogram of lengths (at most ``limit`` numbers) reaches the driver, where the plan is
made on counts: its work does not grow with the documents. Spark gives every piece its rank
among the pieces of its length, and the plan says in which sequence and where that rank lies.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.byte_merges import merger
from furrow.llm.texts import blobs, column, kept_by_worker, keyed, map_batches, map_partition, no_cycle_search, shared_file, staged, table, task
from furrow.llm.token_counts import tokenizer

#: Patterns are built on this many length classes and hold at most so many documents.
CLASSES = 64
DEPTH = 4
#: Sequences with more room than this are packed again by best fit.
SPARE = 4
CACHE_SIZE = 200_000
RUN_CACHE_SIZE = 150_000
KEPT_BYTES = 64
#: Visible characters below the combining marks (U+0130 has one in lower case), and the runs that the tokenizer's pattern makes of them.
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
MARKS = b".,;:!?*$%#&|()-"
RUN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\\w]|_)+")

_workers: dict[int, Ids] = kept_by_worker(__name__)


class Ids(dict):
    """Ids of words, as bytes of little-endian 32-bit numbers, for a tokenizer that drops white space.

    Such a tokenizer treats words between ASCII blanks one by one, so a bounded cache by word
    gives the ids of the whole text. Plain words (no combining mark, no special string) are put
    together from their runs, which are far fewer than the words, are merged by rank and have a
    cache of their own; other words go to the library as they are, and so do all words of a model
    without ranks.
    """

    def __init__(self, vocabulary: bytes):
        super().__init__()
        self.library = tokenizer(vocabulary)
        self.merger = merger(vocabulary)
        self.runs = Runs(*self.merger) if self.merger else None

    def __missing__(self, word: bytes) -> bytes:
        low = word.lower()
        letters = low.rstrip(MARKS)
        runs = self.runs
        if runs is None:
            made = self._encode(word)
        elif letters.isalpha():  # of bytes: a to z alone; what follows is one run
            made = runs[letters] if len(letters) == len(low) else runs[letters] + runs[low[len(letters) :]]
        else:
            plain = word.decode()
            if not PLAIN.fullmatch(plain) or "<|" in plain:
                made = self._encode(word)
            else:
                low = plain.lower()
                found = (low,) if low.isalpha() else RUN.findall(low)
                made = b"".join([runs[x.encode()] for x in found])
        if len(word) <= KEPT_BYTES:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = made
        return made

    def _encode(self, word: bytes) -> bytes:
        return np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()


class Runs(dict):
    """Ids of runs in lower case, by their bytes."""

    def __init__(self, merge, end: bytes):
        super().__init__()
        self.merge, self.end = merge, end

    def __missing__(self, run: bytes) -> bytes:
        ids = self.merge(run + self.end)
        made = struct.pack(f"<{len(ids)}I", *ids)
        if len(run) <= KEPT_BYTES:
            if len(self) >= RUN_CACHE_SIZE:
                self.clear()
            self[run] = made
        return made


def _ids(vocabulary) -> Ids:
    key = zlib.crc32(vocabulary.value)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Ids(vocabulary.value)
    return _workers[key]


def pieces(docs: DataFrame, tokenizer_path: str, limit: int, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of every document's ids, each with its task and its rank among the task's pieces of that length."""
    vocabulary = shared_file(docs.sparkSession, tokenizer_path)
    end = np.array([end_id], "<u4").tobytes()
    schema = [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0] * (limit + 1)
        here = task()
        for batch in batches:
            cache = _ids(vocabulary)
            rows = []
            with no_cycle_search():
                for doc_id, text in zip(column(batch, "doc_id"), blobs(batch, "text")):
                    ids = b"".join(map(cache.__getitem__, text.split())) + end
                    total = len(ids) // 4
                    for piece, start in enumerate(range(0, total, limit)):
                        part = ids[4 * start : 4 * (start + limit)]
                        size = len(part) // 4
                        rows.append((doc_id, piece, start, size, zlib.crc32(part), here, seen[size]))
                        seen[size] += 1
            if rows:
                yield table(schema, *map(list, zip(*rows)))

    ready = keyed(docs, key, text).select(F.col("doc_id").cast("long"), "text")
    return map_partition(ready, run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def class_patterns(classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All falling tuples of 1 to ``depth`` length classes whose sum is ``classes``."""

    def fill(left: int, most: int, room: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif room:
            for first in range(min(left, most), (left - 1) // room, -1):
                for rest in fill(left - first, first, room - 1):
                    yield (first, *rest)

    return list(fill(classes, classes, depth))


def nonnegative_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 that makes ``|a x - b|`` least, by the active-set method."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(10 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            fit = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (fit > 0).all():
                break
            bad = fit <= 0
            step = min(1.0, float((x[at][bad] / np.maximum(x[at][bad] - fit[bad], 1e-300)).min()))
            x[at] += step * (fit - x[at])
            active[at[bad & (x[at] <= 1e-12)]] = False
            if bad.any() and active[at[bad]].all():  # rounding kept all of them: drop the least
                active[at[bad][x[at][bad].argmin()]] = False
            x[~active] = 0.0
        x[:] = 0.0
        x[at] = fit
    return x


class Plan:
    """Sequences of equal composition as groups, and for every length the ranks that each group takes."""

    def __init__(self, limit: int):
        self.limit = limit
        self.groups: list[list] = []  # [lengths, number of sequences]
        self.open: dict[int, list[int]] = {}  # room -> groups

    def add(self, lengths: list[int], count: int) -> None:
        room = self.limit - sum(lengths)
        self.groups.append([lengths, count])
        self.open.setdefault(room, []).append(len(self.groups) - 1)

    def best_fit(self, length: int, count: int) -> None:
        """Put ``count`` pieces of one length where the least room is left over, then open sequences."""
        while count:
            fitting = [room for room, groups in self.open.items() if room >= length and groups]
            if not fitting:
                break
            room = min(fitting)
            at = self.open[room].pop()
            lengths, free = self.groups[at]
            taken = min(count, free)
            if taken < free:
                self.groups[at][1] = free - taken
                self.open[room].append(at)
            else:
                self.groups[at][1] = 0
            self.add([*lengths, length], taken)
            count -= taken
        each = self.limit // length
        if count >= each:
            self.add([length] * each, count // each)
        if count % each:
            self.add([length] * (count % each), 1)

    def fill(self, left: dict[int, int]) -> None:
        for length in sorted(left, reverse=True):
            self.best_fit(length, left[length])

    def take_apart(self, spare: int) -> dict[int, int]:
        """Sequences with more than ``spare`` tokens of room are undone; the histogram of their pieces."""
        found: dict[int, int] = {}
        for group in self.groups:
            if self.limit - sum(group[0]) > spare:
                for length in group[0]:
                    found[length] = found.get(length, 0) + group[1]
                group[1] = 0
        self.open = {}
        return found

    def slots(self) -> dict[str, np.ndarray]:
        """Per length: first rank, first sequence and offset of each run of ranks, sorted."""
        rows, sequence, taken = [], 0, [0] * (self.limit + 1)
        for lengths, count in self.groups:
            if not count:
                continue
            for length, offset in zip(lengths, accumulate([0, *lengths])):
                rows.append((length, taken[length], sequence, offset))
                taken[length] += count
            sequence += count
        rows.sort()
        found = np.array(rows, np.int64).reshape(-1, 4)
        return {"length": found[:, 0], "rank": found[:, 1], "sequence": found[:, 2], "offset": found[:, 3]}


def make_plan(histogram: dict[int, int], limit: int, classes: int = CLASSES, depth: int = DEPTH) -> Plan:
    """``histogram``: pieces per length, 1 to ``limit``.

    Lengths are rounded to the nearest class, so a pattern's sum is right on average. Its last and
    shortest place stays open: with the residuals, the pieces counted for these places are packed
    by best fit, longest first, which makes up for the rounding. The others always fit together.
    Sequences that still have more than ``SPARE`` tokens of room are residuals too.
    """
    plan = Plan(limit)
    left = {n: c for n, c in histogram.items() if c}
    if left.get(limit):
        plan.add([limit], left.pop(limit))
    unit = -(-limit // classes)
    by_class: dict[int, list[int]] = {}
    for length in sorted(left):  # the longest of a class is taken first
        by_class.setdefault(max(1, round(length / unit)), []).append(length)
    patterns = [
        p for p in class_patterns(limit // unit, depth)
        if all(c in by_class for c in p) and sum(by_class[c][-1] for c in p[:-1]) <= limit
    ]
    if patterns:
        present = sorted(by_class)
        place = {c: i for i, c in enumerate(present)}
        a = np.zeros((len(present), len(patterns)))
        for j, pattern in enumerate(patterns):
            for c in pattern:
                a[place[c], j] += 1
        b = np.array([sum(left[n] for n in by_class[c]) for c in present], float)
        scale = max(1.0, b.max())
        repeats = np.rint(nonnegative_fit(a, b / scale) * scale).astype(np.int64)
        free = {c: sum(left[n] for n in by_class[c]) for c in by_class}
        for j in np.argsort(-repeats, kind="stable"):
            *first, _ = patterns[j]
            count = min([int(repeats[j]), *(free[c] // patterns[j].count(c) for c in set(patterns[j]))])
            for c in patterns[j]:
                free[c] -= count
            if first:
                _take(plan, [by_class[c] for c in first], left, count)
    plan.fill(left)
    plan.fill(plan.take_apart(SPARE))
    return plan


def _take(plan: Plan, classes: list[list[int]], left: dict[int, int], count: int) -> None:
    """``count`` sequences with one piece of each class, the longest left; equal ones are one group."""
    runs = []
    for lengths in classes:
        need, run = count, []
        for length in reversed(lengths):
            taken = min(need, left[length])
            if taken:
                left[length] -= taken
                need -= taken
                run.append([length, taken])
        runs.append(run)
    while count:
        step = min(run[-1][1] for run in runs)
        plan.add([run[-1][0] for run in runs], step)
        count -= step
        for run in runs:
            run[-1][1] -= step
            if not run[-1][1]:
                run.pop()


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: every piece in one place.

    Null and empty texts are their end id alone. Equal lengths are placed in the order of task
    and rank; repeated rows and null keys are packed like others; an empty table packs nothing.
    Other columns are not read.
    """
    spark = docs.sparkSession
    found = staged(pieces(docs, tokenizer_path, limit, key, text), "pieces")
    counts = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    per_length = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(make_plan(per_length, limit).slots())
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = found.join(offsets, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )
    schema = [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        plan = slots.value
        first = np.searchsorted(plan["length"], np.arange(limit + 2))
        length = batch.column(3).to_numpy()
        rank = batch.column(5).to_numpy()
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):
            own = length == n
            low, high = first[n], first[n + 1]
            at[own] = low + np.searchsorted(plan["rank"][low:high], rank[own], side="right") - 1
        sequence = plan["sequence"][at] + rank - plan["rank"][at]
        return table(schema, *batch.columns[:5], sequence, plan["offset"][at])

    return map_batches(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
