"""SimHash near-duplicates by a binary trie self-join.

Fingerprints of equal value are one class. Pairs of trie nodes are walked together: each step
adds the bit in which two children differ, and a pair is dropped when its differing bits are
over the budget. To spread the walk over tasks and to keep it narrow, the 64 bits are seen as
four quarters: two fingerprints with at most ``distance`` differing bits have a quarter with at
most ``distance // 4`` of them, so four tries, each with another quarter first, find every pair
while allowing only that many differences on their first 16 levels. A task walks one pair of
subtrees below equal or neighbouring prefixes.

Links found by a task leave it as a spanning forest (fewer links than fingerprints), so a
group of near copies never sends its pairs. Node pairs whose fingerprints are already in one
tree are not walked further.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.components import components
from furrow.llm.texts import blobs, keyed, map_batches, staged, table, windows

QUARTERS = 4
QUARTER_BITS = 16
#: Fingerprints below one subtree, as planned.
SUBTREE = 1 << 15
SEED = 42


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bit i is set if it is set in over half the shingle hashes; no word gives zero."""
    shingles = windows(words, shingle) or ([b" ".join(words)] if words else [])
    if not shingles:
        return 0
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        block = hashes[start : start + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, mark, other_mark, bits``: two hashes of id and text, the fingerprint as a signed 64-bit number."""
    schema = [("doc_id", pa.int64()), ("mark", pa.int64()), ("other_mark", pa.int64()), ("bits", pa.int64())]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(x.lower().split(), shingle) for x in blobs(batch, "text")], np.uint64)
        return table(schema, *batch.columns[:3], made.view(np.int64))

    ready = keyed(docs, key, text).select(F.col("doc_id").cast("long"), "text")
    ready = ready.select("doc_id", *marks(F.col("doc_id"), F.col("text")), "text")
    return map_batches(ready, each, "doc_id long, mark long, other_mark long, bits long")


def marks(key: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that tell rows of other id or text apart."""
    parts = [key.isNull(), key.cast("long"), text.isNull(), text]
    return F.xxhash64(*parts).alias("mark"), F.xxhash64(F.lit(1), *reversed(parts)).alias("other_mark")


def rotated(bits: np.ndarray, quarter: int) -> np.ndarray:
    """The same bits with another quarter first."""
    turn = np.uint64(quarter * QUARTER_BITS)
    return bits if not quarter else (bits << turn) | (bits >> (np.uint64(64) - turn))


def subtree_rows(bits: np.ndarray, prefix: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each trie: quarter, subtree pair (lower prefix first), and the fingerprints that it needs.

    A fingerprint goes to the pair of its own subtree and to every pair with a subtree whose
    prefix differs in at most ``distance // 4`` bits.
    """
    for quarter in range(QUARTERS):
        own = rotated(bits, quarter) >> np.uint64(64 - prefix) if prefix else np.zeros(len(bits), np.uint64)
        for flips in range(min(distance // QUARTERS, prefix) + 1):
            for places in combinations(range(prefix), flips):
                other = own ^ np.uint64(sum(1 << p for p in places))
                yield np.full(len(bits), quarter, np.int32), np.minimum(own, other), np.maximum(own, other), bits


class Forest:
    """Union-find over positions, with the links that joined two trees."""

    def __init__(self, size: int):
        self.root = np.arange(size)
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.root[at]
        while True:
            further = self.root[found]
            if (further == found).all():
                return found
            found = further

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        differ = self.roots(a) != self.roots(b)
        for x, y in zip(a[differ].tolist(), b[differ].tolist()):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                self.links.append((x, y))


def walk(values: np.ndarray, left: tuple[int, int], right: tuple[int, int], level: int, distance: int, first: int, forest: Forest) -> None:
    """Join all pairs between two subtrees of the sorted ``values`` that differ in few enough bits.

    A node is a range of ``values`` that agree on the first ``level`` bits. ``first``: the bits
    that may differ on the levels of the leading quarter. Blocks of node pairs go down together, so
    memory holds a bounded number of pairs; small nodes are compared directly.
    """
    block, small = 1 << 16, 4
    stack = [(np.array([[*left, *right]], np.int64), level)]
    while stack:
        nodes, level = stack.pop()
        if len(nodes) > block:
            stack.append((nodes[block:], level))
            nodes = nodes[:block]
        a0, a1, b0, b1 = nodes.T
        few = (a1 - a0) * (b1 - b0) <= small * small
        if few.any():
            _compare(values, nodes[few], distance, forest)
            nodes = nodes[~few]
        if not len(nodes) or level == 64:
            continue
        nodes = nodes[~_joined(forest, nodes)]
        if not len(nodes):
            continue
        a0, a1, b0, b1 = nodes.T
        bit = np.uint64(1) << np.uint64(63 - level)
        am, bm = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        lower = np.stack([a0, am, b0, bm], 1)
        upper = np.stack([am, a1, bm, b1], 1)
        crossed = np.stack([a0, am, bm, b1], 1)
        back = np.stack([am, a1, b0, bm], 1)[~same]
        made = np.concatenate([lower, upper, crossed, back])
        made = made[(made[:, 1] > made[:, 0]) & (made[:, 3] > made[:, 2])]
        mask = ~np.uint64(0) << np.uint64(63 - level)
        lead = ~np.uint64(0) << np.uint64(64 - min(level + 1, QUARTER_BITS))
        apart = values[made[:, 0]] ^ values[made[:, 2]]
        made = made[(np.bitwise_count(apart & mask) <= distance) & (np.bitwise_count(apart & lead) <= first)]
        if len(made):
            stack.append((made, level + 1))


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the given bit turns from 0 to 1 inside each range, by bisection."""
    low, high = low.copy(), high.copy()
    while True:
        going = low < high
        if not going.any():
            return low
        middle = (low + high) >> 1
        ones = (values[np.minimum(middle, len(values) - 1)] & bit) != 0
        high = np.where(going & ones, middle, high)
        low = np.where(going & ~ones, middle + 1, low)


def _joined(forest: Forest, nodes: np.ndarray) -> np.ndarray:
    """Node pairs that lie within one tree as a whole: nothing below can join anything.

    ``changes`` counts the changes of root along the sorted fingerprints, so a range without a
    change is of one tree.
    """
    if not forest.links:
        return np.zeros(len(nodes), bool)
    roots = forest.roots(np.arange(len(forest.root)))
    changes = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
    a0, a1, b0, b1 = nodes.T
    return (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (roots[a0] == roots[b0])


def _compare(values: np.ndarray, nodes: np.ndarray, distance: int, forest: Forest) -> None:
    a0, a1, b0, b1 = nodes.T
    for i in range(int((a1 - a0).max())):
        for j in range(int((b1 - b0).max())):
            x, y = a0 + i, b0 + j
            there = (x < a1) & (y < b1) & (x != y)
            x, y = x[there], y[there]
            near = np.bitwise_count(values[x] ^ values[y]) <= distance
            forest.join(x[near], y[near])


def subtree_links(quarter: int, low: int, high: int, bits: np.ndarray, prefix: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two subtrees of one trie (or inside one)."""
    values = np.unique(rotated(bits, quarter))
    own = values >> np.uint64(64 - prefix) if prefix else np.zeros(len(values), np.uint64)
    forest = Forest(len(values))
    ends = [int(np.searchsorted(own, np.uint64(x), side)) for x in (low, high) for side in ("left", "right")]
    if ends[0] < ends[1] and ends[2] < ends[3]:
        walk(values, (ends[0], ends[1]), (ends[2], ends[3]), prefix, distance, distance // QUARTERS, forest)
    at = np.array(forest.links, np.int64).reshape(-1, 2)
    back = rotated(values, (QUARTERS - quarter) % QUARTERS)
    return back[at[:, 0]], back[at[:, 1]]


def links(distinct: DataFrame, distance: int, subtree: int = SUBTREE) -> DataFrame:
    """``a, b``: links between different fingerprints that connect all that are near enough."""
    count = distinct.count()
    prefix = min(QUARTER_BITS, max(3, int(np.ceil(np.log2(max(count, 1) / subtree))) + 1 if count else 3))
    rows_schema = [("quarter", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("bits", pa.int64())]

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = batch.column(0).to_numpy().view(np.uint64)
        parts = [np.concatenate(x) for x in zip(*subtree_rows(bits, prefix, distance))]
        return table(rows_schema, parts[0], parts[1].astype(np.int64), parts[2].astype(np.int64), parts[3].view(np.int64))

    def each(key, rows):
        quarter, low, high = (x.as_py() for x in key)
        bits = rows.column("bits").combine_chunks().to_numpy().view(np.uint64)
        a, b = subtree_links(quarter, low, high, bits, prefix, distance)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    spread_out = map_batches(distinct, spread, "quarter int, low long, high long, bits long")
    return spread_out.groupBy("quarter", "low", "high").applyInArrow(each, "a long, b long")


def labelled(docs: DataFrame, shingle: int, distance: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``fingerprints`` with ``group`` (its smallest fingerprint) and ``component_id``."""
    made = staged(fingerprints(docs, shingle, key, text), "fingerprints")
    classes = staged(made.groupBy("bits").agg(F.min("doc_id").alias("first")), "classes")
    joined = components(links(classes.select("bits"), distance))
    named = classes.join(joined.withColumnRenamed("node", "bits"), "bits", "left").withColumn("group", F.coalesce("root", "bits"))
    first = named.groupBy("group").agg(F.min("first").alias("component_id"))
    labels = named.join(first, "group").select(F.col("bits").alias("_bits"), "group", "component_id")
    # Rows are gathered per task and fingerprint first: the join meets a fingerprint once per task,
    # so one of very many rows is no hot key.
    own = [c for c in made.columns if c != "bits"]
    gathered = made.groupBy(F.spark_partition_id().alias("part"), "bits").agg(F.collect_list(F.struct(*own)).alias("rows"))
    found = gathered.join(labels, F.col("bits") == F.col("_bits")).select("bits", "group", "component_id", F.explode("rows").alias("r"))
    return found.select("r.*", "bits", "group", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row.

    ``component_id`` is the smallest ``doc_id`` that can be reached over links of at most
    ``distance`` differing bits. Null texts and texts without a word have fingerprint zero and
    link like any other; rows with equal ``doc_id`` each get a row; a null ``doc_id`` never
    names a component unless it is alone; an empty table gives an empty result.
    """
    found = labelled(docs, shingle, distance, key, text)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, shingle: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of every group the one with the smallest id (then by hash of id and text)."""
    found = labelled(docs, shingle, distance, key, text)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "other_mark")
    chosen = found.groupBy("group").agg(F.min(order).alias("least")).select("least.mark", "least.other_mark")
    names = ["mark", "other_mark"]
    own = [x.alias(n) for n, x in zip(names, marks(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string")))]
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *own)
    return marked.join(chosen, names, "left_semi").dropDuplicates(names).select("row.*")
