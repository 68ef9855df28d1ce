"""Document fingerprints by consistent weighted sampling.

Terms are the lower-cased words, weighted by how often the text has them. For sample k every term
draws r and c from Gamma(2, 1) and b from the unit interval, by hash of term and k, so all texts
share the draws. With t = floor(ln w / r + b) and ln y = r (t - b) the term with the least
ln c - ln y - r wins, and the sample is (term, t). Two texts agree in a sample with a probability
equal to their generalised Jaccard similarity, sum of least weights over sum of largest weights.

A term and weight have the same values in every text, so workers keep them for frequent pairs in a
bounded table. No step looks at more than one text and its neighbour.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.texts import blobs, column, kept_by_worker, map_batches, map_partition, staged, table, task

SAMPLES = 64
GRID = 1 << 14
#: Term and weight pairs that a worker keeps; each takes SAMPLES * 8 bytes.
KEPT_PAIRS = 60_000
#: Pairs that are looked up at a time, and that are evaluated at a time: those stay in the processor's cache.
BLOCK = 4096
CHUNK = 256
#: Places for pairs that come when a worker has its first ones, and after how many times all places such pairs it begins anew.
RECENT_PAIRS = 2 * BLOCK
RENEWED = 16
SIGN = np.uint32(0x80000000)


def _gamma_quantiles(steps: int) -> np.ndarray:
    """Middles of equal shares of Gamma(2, 1): solves 1 - (1 + x) exp(-x) = p by bisection."""
    p = (np.arange(steps) + 0.5) / steps
    low, high = np.zeros(steps), np.full(steps, 60.0)
    for _ in range(80):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return high


class Samples:
    """Order and sign of every sample for (term, weight); least order wins, the sign is then kept.

    Both are packed into one number, so the least over a text's pairs is one reduction.
    """

    def __init__(self, samples: int = SAMPLES, kept: int = KEPT_PAIRS):
        self.samples, self.kept = samples, max(kept, 2 * RECENT_PAIRS)
        self.seeds = np.array([xxhash.xxh64_intdigest(str(k), 7) for k in range(samples)], np.uint64)
        scale = _gamma_quantiles(GRID)
        self.r = scale.astype(np.float32)
        self.log_c = np.log(scale).astype(np.float32)
        self.place: dict[bytes, int] = {}
        self.values = np.empty((self.kept, samples), np.uint64)
        self.recent: list[bytes] = []  # the pairs in the last RECENT_PAIRS places
        self.turns = 0

    def evaluate(self, keys: list[bytes]) -> np.ndarray:
        """``keys``: a term, or a term, a zero byte and its weight if that is over 1."""
        parts = [x.partition(b"\0") for x in keys]
        terms = np.fromiter((xxhash.xxh64_intdigest(x[0]) for x in parts), np.uint64, len(parts))
        counts = np.array([int(x[2] or 1) for x in parts], np.float32)
        found = np.empty((len(keys), self.samples), np.uint64)
        for single in (True, False):
            at = np.flatnonzero((counts == 1) == single)
            for start in range(0, len(at), CHUNK):
                own = at[start : start + CHUNK]
                found[own] = self._evaluate(terms[own][:, None], None if single else np.log(counts[own])[:, None])
        return found

    def _evaluate(self, terms: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
        """Of a chunk of terms; ``weight`` is the logarithm, None if all are 0: then every t is 0."""
        x = terms * np.uint64(0x9E3779B97F4A7C15) ^ self.seeds
        moved = x >> np.uint64(30)
        x ^= moved
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= np.right_shift(x, np.uint64(27), out=moved)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= np.right_shift(x, np.uint64(31), out=moved)
        r = self.r.take(np.bitwise_and(x, np.uint64(GRID - 1), out=moved).view(np.int64))
        np.right_shift(x, np.uint64(14), out=moved)
        moved &= np.uint64(GRID - 1)
        log_c = self.log_c.take(moved.view(np.int64))
        b = np.right_shift(x, np.uint64(40), out=moved).astype(np.int32).astype(np.float32)
        b *= np.float32(2.0**-24)
        if weight is None:
            step = np.float32(1) - b
            sign = terms
        else:
            t = np.floor(weight / r + b)
            step = t - b
            step += np.float32(1)
            sign = terms ^ t.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        step *= r
        order = np.subtract(log_c, step, out=log_c).view(np.uint32)
        order ^= (order.view(np.int32) >> 31).view(np.uint32) | SIGN  # all bits of a negative number, else the first
        sign = (sign * np.uint64(0x165667B19E3779F9) >> np.uint64(32)).astype(np.uint32)
        # sign % 65535 + 1: 65536 leaves 1, so the two halves are added
        sign = (sign >> 16) + (sign & np.uint32(0xFFFF)) + np.uint32(1)
        sign += sign >> 16
        sign = (sign & np.uint32(0xFFFF)) + (sign >> 17)
        found = order.astype(np.uint64)
        found <<= np.uint64(32)
        found |= sign
        return found

    def rows(self, keys: list[bytes]) -> np.ndarray:
        """Places of at most ``BLOCK`` different keys in ``values``.

        The first pairs that come stay; those after them share the last places, which are given away
        when they are full. From time to time all are, as texts may change.
        """
        place = self.place
        known = place.get
        found = np.array([known(x, -1) for x in keys], np.int64)
        gaps = np.flatnonzero(found < 0)
        if not len(gaps):
            return found
        if len(place) + len(gaps) > self.kept:
            self.turns += 1
            if self.turns * RECENT_PAIRS > RENEWED * self.kept:
                place.clear()
                self.turns = 0
            else:
                for x in self.recent:
                    del place[x]
            self.recent.clear()
            return self.rows(keys)
        missed = [keys[i] for i in gaps.tolist()]
        start = len(place)
        found[gaps] = np.arange(start, start + len(missed))
        self.values[start : start + len(missed)] = self.evaluate(missed)
        place.update(zip(missed, range(start, start + len(missed))))
        self.recent += missed[max(0, self.kept - RECENT_PAIRS - start) :]
        return found

    def signature(self, text: bytes) -> np.ndarray:
        """One 16-bit sign per sample; all zero for a text without words."""
        counts = Counter(text.lower().split())
        if b"\0" in text:
            counts = {x.replace(b"\0", b"\xff"): n for x, n in counts.items()}
        keys = [x if n == 1 else b"%b\0%d" % (x, n) for x, n in counts.items()]
        if not keys:
            return np.zeros(self.samples, np.uint16)
        best = None
        for start in range(0, len(keys), BLOCK):
            least = self.values[self.rows(keys[start : start + BLOCK])].min(axis=0)
            best = least if best is None else np.minimum(best, least)
        return (best & np.uint64(0xFFFF)).astype(np.uint16)


_samples: dict[int, Samples] = kept_by_worker(__name__)


def samples(number: int) -> Samples:
    if number not in _samples:
        _samples[number] = Samples(number)
    return _samples[number]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples, the estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, other: str) -> str:
    """The last quarter of the code points replaced by the first as many of another text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + other[:cut]


def fingerprints(docs: DataFrame, number: int = SAMPLES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` per row: 4 hex digits per sample."""
    schema = [("doc_id", pa.int64()), ("fingerprint", pa.string())]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        maker = samples(number)
        return table(schema, batch.column(0), [maker.signature(x).tobytes().hex() for x in blobs(batch, "text")])

    ready = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_batches(ready, each, "doc_id long, fingerprint string")


FOUND = "doc_id long, n_chars long, edited_sha256 string, signature binary, edited_signature binary, near_edited double, near_next double"
FOUND_SCHEMA = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("signature", pa.binary()),
    ("edited_signature", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]


def _judged(maker: Samples, doc_id, text: str, own: np.ndarray, after: str, following: np.ndarray) -> tuple:
    changed = edited(text, after).encode()
    signature = maker.signature(changed)
    return (
        doc_id, len(text), sha256(changed).hexdigest(), own.tobytes(), signature.tobytes(), likeness(own, signature), likeness(own, following),
    )


def with_neighbours(docs: DataFrame, number: int = SAMPLES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row.

    Rows are dealt into ranges of ``doc_id`` and sorted (equal ids by text, null ids first), so the
    next row is at hand, but for the last row of a range: one row per range is settled by a
    second, small join. The last row of all is followed by the first; a single row follows itself.
    Null texts are empty; two texts without words are alike (1).
    """
    ready = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    dealt = ready.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = [("part", pa.int32()), ("end", pa.string()), ("text", pa.string()), *FOUND_SCHEMA]

    def run(batches):
        maker, here = samples(number), task()
        before = None
        for batch in batches:
            rows = []
            for doc_id, content in zip(column(batch, "doc_id"), column(batch, "text")):
                own = maker.signature(content.encode())
                if before is None:
                    rows.append((here, "first", content, doc_id, None, None, own.tobytes(), None, None, None))
                else:
                    rows.append((here, None, None, *_judged(maker, *before, content, own)))
                before = (doc_id, content, own)
            if rows:
                yield table(schema, *map(list, zip(*rows)))
        if before is not None:
            doc_id, content, own = before
            yield table(schema, [here], ["last"], [content], [doc_id], [None], [None], [own.tobytes()], [None], [None], [None])

    made = staged(map_partition(dealt, run, f"part int, end string, text string, {FOUND}"), "ranges")
    first = made.where("end = 'first'").select("part", F.col("text").alias("after"), F.col("signature").alias("following"))
    # One row per range, and only its number.
    order = Window.orderBy("part")
    parts = first.select("part", F.lead("part").over(order).alias("then"), F.first("part").over(order).alias("start"))
    parts = parts.select(F.col("part").alias("own"), F.coalesce("then", "start").alias("part"))
    last = made.where("end = 'last'").select(F.col("part").alias("own"), "doc_id", "text", "signature")
    ends = last.join(parts, "own").join(first, "part").select("doc_id", "text", "signature", "after", "following")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        maker = samples(number)
        rows = [
            _judged(maker, x["doc_id"], x["text"], np.frombuffer(x["signature"], np.uint16), x["after"], np.frombuffer(x["following"], np.uint16))
            for x in batch.to_pylist()
        ]
        return table(FOUND_SCHEMA, *map(list, zip(*rows)))

    inner = made.where("end IS NULL").select(*[name for name, _ in FOUND_SCHEMA])
    found = inner.union(map_batches(ends, finish, FOUND))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        F.lower(F.hex("signature")).alias("fingerprint"),
        F.lower(F.hex("edited_signature")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
