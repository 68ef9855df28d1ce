"""Line dedup with exact reference counts and sharded cuckoo filters; documents can be added and taken out.

State: a table ``key, refs`` that counts, for every line key (128-bit digest), the documents that
hold it. Adding documents adds their counts, deleting documents subtracts them, and a key whose
count falls below the limit keeps its lines again: nothing else is remembered, so every step can
be undone.

Filters: the keys at or over the limit are put into cuckoo filters, one per shard, each built in
one task from its part of the table. A line that no filter knows is kept without moving; a line
that a filter knows is a candidate and is checked against the exact table. The filters that are
broadcast hold at most ``filter_bytes``; where there are more shards, lines of the others are
candidates too, so the result is exact at every size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.texts import BLANKS, blobs, column, map_batches, map_partition, staged, table, task

#: Keys per filter, as planned, and bytes of filters that are broadcast at most.
SHARD_KEYS = 1 << 16
FILTER_BYTES = 64 << 20
SLOTS = 4
#: Keys that a task counts before it sends what it has.
HELD_KEYS = 200_000


def line_key(line: bytes) -> bytes:
    """A line without blanks at both ends, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def digests(lines: list[bytes], least: int) -> list[bytes | None]:
    """Digest of each line's key; None if the key has fewer than ``least`` code points."""
    found = []
    for line in lines:
        key = line_key(line)
        short = len(key) < least or (least > 1 and len(key.decode()) < least)
        found.append(None if short else digest(key))
    return found


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; supports insert, delete and lookup.

    A key has two buckets; the second is the first xor a hash of the fingerprint, so each can be
    found from the other. ``insert`` says False when no room was found: the caller builds a larger
    filter.
    """

    def __init__(self, buckets: int):
        self.mask = buckets - 1
        self.cells = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.9 < len(keys):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(map(made.insert, keys)):
                return made
            buckets *= 2

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = (int.from_bytes(key[8:10], "little") % 65535) + 1
        first = int.from_bytes(key[10:14], "little") & self.mask
        return mark, first, first ^ (mark * 0x5BD1 & self.mask)

    def insert(self, key: bytes, kicks: int = 500) -> bool:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return True
        bucket, moved = first, []
        for kick in range(kicks):
            slot = (mark + kick) % SLOTS
            moved.append((bucket, slot))
            mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
            bucket ^= mark * 0x5BD1 & self.mask
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return True
        for bucket, slot in reversed(moved):  # put everything back: a failed insert changes nothing
            mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
        return False

    def delete(self, key: bytes) -> bool:
        """Take one copy of a key out that was inserted before."""
        mark, first, second = self._places(key)
        for bucket in (first, second):
            own = np.flatnonzero(self.cells[bucket] == mark)
            if len(own):
                self.cells[bucket, own[0]] = 0
                return True
        return False

    def __contains__(self, key: bytes) -> bool:
        mark, first, second = self._places(key)
        return bool((self.cells[first] == mark).any() or (self.cells[second] == mark).any())

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Lookup of many keys, rows of 16 bytes."""
        mark = (keys[:, 8].astype(np.int64) | keys[:, 9].astype(np.int64) << 8) % 65535 + 1
        first = keys[:, 10:14].copy().view("<u4")[:, 0].astype(np.int64) & self.mask
        second = first ^ (mark * 0x5BD1 & self.mask)
        mark = mark[:, None]
        return (self.cells[first] == mark).any(1) | (self.cells[second] == mark).any(1)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, :4].copy().view(">u4")[:, 0].astype(np.int64)) % shards


def line_refs(docs: DataFrame, least: int = 1, text: str = "text") -> DataFrame:
    """``key, refs``: in how many documents (rows) each line key is found; summed per task before the shuffle."""
    schema = [("key", pa.binary()), ("refs", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for content in blobs(batch, "text"):
                held.update(set(digests(content.split(b"\n"), least)))
                if len(held) > HELD_KEYS:
                    held.pop(None, None)
                    yield table(schema, list(held.keys()), list(held.values()))
                    held = Counter()
        held.pop(None, None)
        if held:
            yield table(schema, list(held.keys()), list(held.values()))

    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    return map_partition(texts, run, "key binary, refs long").groupBy("key").agg(F.sum("refs").alias("refs"))


def add_documents(refs: DataFrame, docs: DataFrame, least: int = 1) -> DataFrame:
    """The table of counts after ``docs`` have come in."""
    return refs.select("key", "refs").union(line_refs(docs, least)).groupBy("key").agg(F.sum("refs").alias("refs"))


def delete_documents(refs: DataFrame, docs: DataFrame, least: int = 1) -> DataFrame:
    """The table of counts after ``docs`` have gone; keys that no document holds go with them."""
    gone = line_refs(docs, least).select("key", (-F.col("refs")).alias("refs"))
    return refs.select("key", "refs").union(gone).groupBy("key").agg(F.sum("refs").alias("refs")).where("refs > 0")


def build_filters(repeated: DataFrame, shards: int) -> DataFrame:
    """``shard, cells``: one cuckoo filter per shard over the given keys."""
    shard = F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")

    def each(rows):
        made = CuckooFilter.of(rows.column("key").to_pylist())
        return pa.table({"shard": rows.column("shard")[:1], "cells": pa.array([made.cells.tobytes()], pa.binary())})

    return repeated.select(shard.alias("shard"), "key").groupBy("shard").applyInArrow(each, "shard int, cells binary")


class Filters:
    """The broadcast filters; a key of a shard that is not there counts as held."""

    def __init__(self, shards: int, cells: dict[int, bytes], missing: set[int]):
        self.shards, self.missing = shards, missing
        self.filters = {}
        for shard, content in cells.items():
            made = CuckooFilter(1)
            made.cells = np.frombuffer(content, np.uint16).reshape(-1, SLOTS)
            made.mask = len(made.cells) - 1
            self.filters[shard] = made

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
        shard = shard_of(rows, self.shards)
        found = np.zeros(len(keys), bool)
        for number in np.unique(shard).tolist():
            own = shard == number
            if number in self.missing:
                found[own] = True
            elif number in self.filters:
                found[own] = self.filters[number].holds(rows[own])
        return found


def load_filters(filters: DataFrame, shards: int, most: int) -> tuple[dict[int, bytes], set[int]]:
    """As many filters as fit into ``most`` bytes, smallest shard first, and the shards left out."""
    sizes = filters.select("shard", F.octet_length("cells").alias("n")).orderBy("shard")
    room, taken, missing = most, [], set()
    for row in sizes.toLocalIterator():
        if row["n"] <= room:
            room -= row["n"]
            taken.append(row["shard"])
        else:
            missing.add(row["shard"])
    rows = filters.where(F.col("shard").isin(taken)).collect() if taken else []
    return {row["shard"]: bytes(row["cells"]) for row in rows}, missing


def drop_lines(
    docs: DataFrame,
    limit: int = 10,
    least: int = 1,
    text: str = "text",
    carry: list[str] | None = None,
    refs: DataFrame | None = None,
    filter_bytes: int = FILTER_BYTES,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """``carried, n_lines, n_dropped, kept``: every row with its kept text.

    ``n_dropped`` counts the lines whose key (at least ``least`` code points) is in ``limit``
    documents or more, by ``refs`` or else by ``docs`` themselves; ``kept`` joins the others.
    ``carried`` holds the columns ``carry`` of ``docs``, by default all but the text. Rows are told
    apart by their place in the input, so repeated or null ids do no harm; every row counts as a
    document. Null texts are one empty line; an empty key never drops when ``least`` is 1 or more.
    An empty table gives an empty result.
    """
    counted = staged(line_refs(docs, least, text) if refs is None else refs, "line-refs")
    repeated = counted.where(F.col("refs") >= limit)
    shards = max(1, -(-repeated.count() // shard_keys))
    spark = docs.sparkSession
    content, missing = load_filters(staged(build_filters(repeated, shards), "filters"), shards, filter_bytes)
    sent = spark.sparkContext.broadcast((shards, content, missing))
    columns = [c for c in docs.columns if c != text] if carry is None else carry
    ready = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("carried"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = ready.schema["carried"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(*sent.value)
        here, row = task(), 0
        for batch in batches:
            places, found = [], []
            for content in blobs(batch, "text"):
                own = digests(content.split(b"\n"), least)
                at = [i for i, x in enumerate(own) if x is not None]
                held = filters.candidates([own[i] for i in at]) if at else []
                places.append([i for i, x in zip(at, held) if x])
                found.append([own[i] for i in places[-1]])
            schema = [
                ("part", pa.int32()), ("row", pa.int64()), ("carried", batch.schema.field(0).type), ("text", pa.string()),
                ("lines", pa.list_(pa.int32())), ("keys", pa.list_(pa.binary())),
            ]
            yield table(schema, [here] * len(places), list(range(row, row + len(places))), batch.column(0), batch.column(1), places, found)
            row += len(places)

    probed = staged(
        map_partition(ready, probe, f"part int, row long, carried {kind}, text string, lines array<int>, keys array<binary>"), "probed"
    )
    asked = probed.where(F.size("keys") > 0).select("part", "row", F.explode(F.arrays_zip("lines", "keys")).alias("c"))
    # One row per task and key meets the exact table, however many lines of the task ask.
    asked = asked.groupBy("part", F.col("c.keys").alias("key")).agg(F.collect_list(F.struct("row", F.col("c.lines").alias("line"))).alias("at"))
    sure = asked.join(repeated.select("key"), "key", "left_semi").select("part", F.explode("at").alias("at"))
    drops = sure.groupBy("part", F.col("at.row").alias("row")).agg(F.collect_list("at.line").alias("drop"))
    joined = probed.where(F.size("keys") > 0).select("part", "row", "carried", "text").join(drops, ["part", "row"], "left")
    clear = probed.where(F.size("keys") == 0).select("carried", "text", F.lit(None).cast("array<int>").alias("drop"))
    return _kept(joined.select("carried", "text", "drop").union(clear))


def _kept(rows: DataFrame) -> DataFrame:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines_of, dropped, kept = [], [], []
        for content, drop in zip(blobs(batch, "text"), column(batch, "drop")):
            lines = content.split(b"\n")
            gone = set(drop or ())
            lines_of.append(len(lines))
            dropped.append(len(gone))
            kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else content)
        texts = pa.array(kept, pa.binary()).cast(pa.string())
        schema = [("carried", batch.schema.field(0).type), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())]
        return table(schema, batch.column(0), lines_of, dropped, texts)

    kind = rows.schema["carried"].dataType.simpleString()
    return map_batches(rows, each, f"carried {kind}, n_lines long, n_dropped long, kept string")


def digest_columns(kept: DataFrame) -> DataFrame:
    return kept.select("carried.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
