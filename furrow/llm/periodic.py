"""Periodic runs of words: stretches that repeat with a period, found by longest common extensions.

A run of period q and length L makes L - q words in a row equal to the word q places on. A grid per
period with steps of the least such stretch (harmonic, so about n log n points for all periods) hits every
run, and the common extensions of a grid point and its partner give the run's ends.

An extension of two places compares words until both reach a place of a difference cover; few pairs of
places get that far. Only for their texts the suffixes at cover places are sorted, and the rest of the
extension is a range minimum over their neighbours' common prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.texts import blobs, map_batches, table

#: A perfect difference set: every distance but 0 is met by one pair of residues.
MODULUS = 31
RESIDUES = (0, 1, 3, 8, 12, 18)
#: Words compared at least before the cover is asked: chance repeats end here.
FIRST_WORDS = 8
#: Grid points made at a time.
BLOCK = 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _shifts() -> np.ndarray:
    """``[distance, residue]``: least step from ``FIRST_WORDS`` on that takes both places to the cover."""
    cover = set(RESIDUES)
    made = np.zeros((MODULUS, MODULUS), np.int64)
    for d in range(MODULUS):
        for r in range(MODULUS):
            made[d, r] = min(FIRST_WORDS + (a - r - FIRST_WORDS) % MODULUS for a in cover if (a + d) % MODULUS in cover)
    return made


SHIFTS = _shifts()
PLACE = np.full(MODULUS, -1, np.int64)
PLACE[list(RESIDUES)] = range(len(RESIDUES))


class Cover:
    """Common prefixes of the suffixes at cover places of ``ids`` (numbers from 1 on)."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.size = n
        padded = np.concatenate([ids, np.zeros(MODULUS, ids.dtype)])
        at = np.arange(n)
        at = at[PLACE[at % MODULUS] >= 0]
        self.count = m = len(at)
        words = np.lib.stride_tricks.sliding_window_view(padded, MODULUS)[at]
        # big-endian, so that the order of the bytes is the order of the words
        key = np.ascontiguousarray(words.astype(">u4")).view(f"S{4 * MODULUS}").ravel()
        order = np.argsort(key, kind="stable")
        rank = np.zeros(m, np.int64)
        rank[order] = 1 + np.concatenate([[0], np.cumsum((words[order[1:]] != words[order[:-1]]).any(1))])
        ranks, step = [rank], len(RESIDUES)
        while rank.max(initial=0) < m:
            after = np.zeros(m, np.int64)
            after[: max(m - step, 0)] = rank[step:]
            both = rank * (m + 1) + after
            order = np.argsort(both, kind="stable")
            rank = np.zeros(m, np.int64)
            rank[order] = 1 + np.concatenate([[0], np.cumsum(both[order[1:]] != both[order[:-1]])])
            ranks.append(rank)
            step *= 2
        self.rank = rank - 1
        self.least = _minima(self._neighbours(order, ranks, at, words))

    def _neighbours(self, order: np.ndarray, ranks: list[np.ndarray], at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix and the next one in order."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for level in reversed(range(len(ranks))):
            step = len(RESIDUES) << level
            live = np.flatnonzero((a < self.count) & (b < self.count))
            same = live[ranks[level][a[live]] == ranks[level][b[live]]]
            common[same] += MODULUS << level
            a[same] += step
            b[same] += step
        live = np.flatnonzero((a < self.count) & (b < self.count))
        differ = words[a[live]] != words[b[live]]
        common[live] += np.where(differ.any(1), differ.argmax(1), MODULUS)
        return common

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at cover places ``i`` and ``j``, which differ."""
        whole = (i < self.size) & (j < self.size)
        made = np.zeros(len(i), np.int64)
        x, y = (self.rank[k[whole] // MODULUS * len(RESIDUES) + PLACE[k[whole] % MODULUS]] for k in (i, j))
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        made[whole] = np.minimum(self.least[level, low], self.least[level, high - (1 << level)])
        return made


def _minima(values: np.ndarray) -> np.ndarray:
    """``[k, i]``: least of the ``2 ** k`` values from ``i`` on."""
    levels = [values]
    width = 1
    while 2 * width <= len(values):
        last = levels[-1]
        best = last.copy()
        best[: len(last) - width] = np.minimum(last[: len(last) - width], last[width:])
        levels.append(best)
        width *= 2
    return np.stack(levels)


class Extension:
    """How far the words from two places on are equal; the cover is made when it is first needed."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.padded = np.concatenate([ids, np.zeros(MODULUS + FIRST_WORDS, ids.dtype)])
        self.cover: Cover | None = None

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words on the way to the cover (i < j), and which pairs have reached it without a difference."""
        to = SHIFTS[(j - i) % MODULUS, i % MODULUS]
        made = to.copy()
        live = np.arange(len(i))
        step = 0
        while True:
            live = live[to[live] > step]
            if not len(live):
                break
            same = self.padded[i[live] + step] == self.padded[j[live] + step]
            made[live[~same]] = step
            live = live[same]
            step += 1
        return made, made == to

    def far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.cover is None:
            self.cover = Cover(self.ids)
        return self.cover.common(i, j)


_GRIDS: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]] = {}


def _grid(first: int, last: int, n: int, least: int, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and their partners for the periods from ``first`` to ``last`` of a text of ``n`` words."""
    q = np.arange(first, last + 1, dtype=np.int64)
    step = np.maximum(least - q, (power - 1) * q)
    count = (n - q) // step
    period = np.repeat(q, count)
    number = np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)
    place = (number + 1) * np.repeat(step, count) - 1
    return place, place + period


def grid(n: int, least: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of grid places and their partners a period on; any ``max(least - q, (power - 1) q)`` places in a row hold one of period q."""
    top = n // power
    if n <= 1 << 16:
        held, place, partner = _GRIDS.get((least, power), (0, None, None))
        if held < n:
            held = 1 << max(n - 1, 1).bit_length()
            place, partner = _grid(1, held // power, held, least, power)
            order = np.argsort(partner, kind="stable")
            place, partner = place[order], partner[order]
            _GRIDS[least, power] = held, place, partner
        cut = np.searchsorted(partner, n)
        yield place[:cut], partner[:cut]
        return
    first = 1
    while first <= top:
        last = min(top, first + max(0, BLOCK * max(1, (power - 1) * first) // n))
        yield _grid(first, last, n, least, power)
        first = last + 1


def find_runs(ids: np.ndarray, least: int = 24, power: int = 3) -> np.ndarray:
    """Rows of start, length and smallest period, by start and then period, of the runs of ``ids`` (numbers from 1 on).

    A run has at least ``least`` words and ``power`` (2 or more) periods, and no neighbour continues its period.
    """
    n = len(ids)
    if n < least:
        return np.zeros((0, 3), np.int64)
    ahead, back = Extension(ids), Extension(ids[::-1])
    found = []
    for place, partner in grid(n, least, power):
        hit = np.flatnonzero(ids[place] == ids[partner])
        if not len(hit):
            continue
        i = place[hit]
        q = partner[hit] - i
        right, open_right = ahead.near(i, i + q)
        left, open_left = back.near(n - i - q, n - i)
        need = np.maximum(least - q, (power - 1) * q)
        keep = open_right | open_left | (right + left >= need)
        if not keep.any():
            continue
        i, q, right, left, open_right, open_left, need = (x[keep] for x in (i, q, right, left, open_right, open_left, need))
        if open_right.any():
            at = i[open_right] + right[open_right]
            right[open_right] += ahead.far(at, at + q[open_right])
        if open_left.any():
            at = n - i[open_left] - q[open_left] + left[open_left]
            left[open_left] += back.far(at, at + q[open_left])
        whole = right + left >= need
        found.append(np.stack([(i - left)[whole], (left + right + q)[whole], q[whole]], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    # the same stretch with a multiple of its period comes right after it
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers from 1 on, equal ones alike."""
    index = {word: number for number, word in enumerate(dict.fromkeys(words), 1)}
    return np.fromiter(map(index.__getitem__, words), np.int32, len(words))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: all but those in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 24, power: int = 3, carry: list[str] | None = None) -> DataFrame:
    """``row, n_words, runs, collapsed``: the runs of every text, and its kept words joined by blanks.

    Words are separated by ASCII white space. ``runs`` are ``start`` (word number), ``length`` and smallest
    ``period``, by start and then period. ``row`` holds the columns ``carry`` of ``docs``, by default
    all. A null text has no words; texts are read whole, every row by itself, so copies and repeated rows
    have equal results; an empty table gives an empty one.
    """
    if least < 1 or power < 2:
        raise ValueError("a run has at least one word and two periods")
    ready = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, lists, collapsed = [], [], []
        for data in blobs(batch, "text"):
            words = data.split()
            runs = find_runs(numbered(words), least, power) if len(words) >= least else np.zeros((0, 3), np.int64)
            counts.append(len(words))
            lists.append([dict(zip(("start", "length", "period"), run)) for run in runs.tolist()])
            if len(runs):
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
            collapsed.append(b" ".join(words).decode())
        schema = [("row", batch.schema.field(0).type), ("n_words", pa.int64()), ("runs", kind), ("collapsed", pa.string())]
        return table(schema, batch.column(0), counts, lists, collapsed)

    kept = ready.schema["row"].dataType.simpleString()
    return map_batches(ready, each, f"row {kept}, n_words bigint, runs {RUNS}, collapsed string")


def planted_periods(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text``; one text in ten, by the checksum of its id, goes on with a period from some word on.

    Such a text becomes its words joined by blanks. A null id plants nothing.
    """
    ready = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    ready = ready.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    ready = ready.selectExpr("*", f"if(h % 10 = 0, {words}, null) as words").selectExpr("*", "size(words) as n", "h div 10 as g")
    ready = ready.selectExpr("*", "if(n > 0, g % n, null) as a").selectExpr("*", "1 + (n - a) div (3 + g % 8) as p")
    periodic = "array_join(transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')"
    return ready.selectExpr("doc_id", f"if(n > 0, {periodic}, text) as text")


def digest_columns(found: DataFrame) -> DataFrame:
    """The most repetitive run of each text and digests of its runs and kept words."""
    order = (
        "case when l.length * r.period > r.length * l.period then -1 when l.length * r.period < r.length * l.period then 1"
        " when l.start <> r.start then sign(l.start - r.start) else sign(l.period - r.period) end"
    )
    best = found.selectExpr(
        "row.doc_id", "runs", "collapsed", f"try_element_at(array_sort(runs, (l, r) -> cast({order} as int)), 1) as best"
    )
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return best.selectExpr(
        "doc_id", "cast(size(runs) as bigint) as n_runs", "best.start", "best.length", "best.period",
        "1000 * best.length div best.period as exponent_milli",
        f"sha2({lines}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256",
    )
