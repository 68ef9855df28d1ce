"""Language-model scores by prediction by partial matching, beside a word-count base.

Training texts are seen as streams: the words, each followed by a blank, then an end symbol. Every
task counts its runs of ``ORDER + 1`` bytes and its words; Spark adds them up over all training
documents. The model is what those counts say about all contexts of 0 to ``ORDER`` bytes. A symbol
is predicted by the longest context seen in training: n times seen of T gives (2n - 1) / 2T, and
the rest is the escape to the next shorter context, whose symbols seen above are excluded (its
distribution is scaled up over the others). Below all is the even distribution over the bytes.

The ``contexts`` most frequent contexts are sent to the workers as a trie. It settles every position
whose longest context it has, or whose longer contexts were never seen. The distinct runs at all
other positions meet the whole table of contexts in a join, so every score is that of all counts.
A symbol seen after a context was seen after each shorter one as well, so what a context multiplies
the chances of unseen symbols by is one number, made of its counts and those of the next shorter.

The base adds up word counts. Frequent words are looked up in a broadcast table; the others of each
document meet the whole count table in a join, so every count is exact.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.texts import blobs, column, kept_by_worker, map_partition, most_frequent, staged, table, task

ORDER = 5
#: Contexts in the broadcast trie at most; the others are met in a join.
CONTEXTS = 1 << 17
#: Words are in lower case, so no byte "A" is left; it stands for the end of a document.
END = ord("A")
#: Words in the broadcast table at most, and their longest length in bytes.
FREQUENT = 1 << 17
FREQUENT_BYTES = 32
#: Distinct words, distinct runs and bytes that a task holds before it sends its counts.
HELD_WORDS = 200_000
HELD_RUNS = 1 << 20
CHUNK = 1 << 22

_models: dict[int, tuple] = kept_by_worker(__name__)


def held_out(key: Column, parts: int = 7, part: int = 2) -> Column:
    """The documents that are kept from training: crc32 of the id as text."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def stream(words: list[bytes]) -> bytes:
    """``ORDER`` end symbols as the context of the first byte, the words, one end."""
    pad = b"A" * ORDER
    return b"%b%b A" % (pad, b" ".join(words)) if words else pad + b"A"


def contexts_of(data: np.ndarray) -> np.ndarray:
    """For every position from ``ORDER`` on, the run of ``ORDER`` bytes before it and the byte, as one number."""
    runs = np.zeros(len(data) - ORDER, np.int64)
    for i in range(ORDER + 1):
        runs = runs << 8 | data[i : len(data) - ORDER + i]
    return runs


def run_counts(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(streams), np.uint8)
    runs = contexts_of(data)
    starts = np.cumsum([0, *map(len, streams)])[1:-1]
    if len(starts):  # runs that end in another document's padding are no runs
        kept = np.ones(len(runs), bool)
        for i in range(ORDER):
            kept[starts - ORDER + i] = False
        runs = runs[kept]
    return np.unique(runs, return_counts=True)


def training_counts(docs: DataFrame) -> DataFrame:
    """``word, run, n`` over ``docs (text)``: counts of words (null: ends of documents) and of byte runs."""
    schema = [("word", pa.binary()), ("run", pa.int64()), ("n", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        streams, size, documents = [], 0, 0

        def send_words():
            return table(schema, list(words.keys()), [None] * len(words), list(words.values()))

        def send_runs():
            return table(schema, pa.nulls(len(keys), pa.binary()), keys, counts)

        def merge():
            more, n = run_counts(streams)
            merged, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            return merged, np.bincount(at, np.concatenate([counts, n]), len(merged)).astype(np.int64)

        for batch in batches:
            for text in blobs(batch, "text"):
                own = text.lower().split()
                words.update(own)
                documents += 1
                streams.append(stream(own))
                size += len(streams[-1])
                if size > CHUNK:
                    keys, counts = merge()
                    streams, size = [], 0
                    if len(keys) > HELD_RUNS:
                        yield send_runs()
                        keys, counts = keys[:0], counts[:0]
                if len(words) > HELD_WORDS:
                    yield send_words()
                    words.clear()
        if streams:
            keys, counts = merge()
        if len(keys):
            yield send_runs()
        if documents:
            yield send_words()
            yield table(schema, [None], [None], [documents])

    counted = map_partition(docs.select("text"), run, "word binary, run long, n long")
    return counted.groupBy("word", "run").agg(F.sum("n").alias("n"))


def context_counts(runs: DataFrame, contexts: int = CONTEXTS, order: int = ORDER) -> tuple[tuple[np.ndarray, ...], DataFrame]:
    """``length, context, symbol, n`` of the frequent contexts, by length and context, at most 256 rows each; all others as a table."""
    length = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("length")
    symbol = (F.col("run").bitwiseAND(F.lit(255))).cast("int").alias("symbol")
    each = runs.select("run", "n", length).select(
        "length", F.expr("shiftright(run, 8) & (shiftleft(1L, 8 * length) - 1)").alias("context"), symbol, "n"
    )
    each = staged(each.groupBy("length", "context", "symbol").agg(F.sum("n").alias("n")), "contexts")
    totals = each.where("length > 0").groupBy("length", "context").agg(F.sum("n").alias("n"))
    least = most_frequent(totals, contexts - 1)
    kept = totals.where(F.col("n") >= least).select("length", "context")
    rows = each.join(kept, ["length", "context"], "left_semi").union(each.where("length = 0"))
    found = rows.select("length", "context", "symbol", "n").toArrow().sort_by([("length", "ascending"), ("context", "ascending"), ("symbol", "ascending")])
    return tuple(found.column(i).to_numpy() for i in range(4)), rare_contexts(each, least)


def rare_contexts(each: DataFrame, least: int) -> DataFrame:
    """``length, context, total, seen, escape`` of the contexts seen less than ``least`` times.

    ``seen`` maps symbols to counts; ``escape`` is log10 of the factor for all other symbols. What
    the next shorter context has are the sums over its longer ones, 256 at most.
    """
    shorter = F.expr("context & (shiftleft(1L, 8 * (length - 1)) - 1)").alias("shorter")
    over = Window.partitionBy("length", "shorter")
    rows = each.where("length > 0").select("*", shorter)
    rows = rows.withColumn("below", F.sum("n").over(over))
    rows = rows.withColumn("also", F.sum("n").over(Window.partitionBy("length", "shorter", "symbol")))
    rows = rows.withColumn("total", F.sum("n").over(Window.partitionBy("length", "shorter", "context")))
    made = rows.where(F.col("total") < least).groupBy("length", "shorter", "context").agg(
        F.first("total").alias("total"),
        F.first("below").alias("below"),
        F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("seen"),
        F.sum(2 * F.col("also") - 1).alias("excluded"),
    )
    escape = F.size("seen") / (2 * F.col("total")) / (1 - F.col("excluded") / (2 * F.col("below")))
    return made.select("length", "context", "total", "seen", F.log10(escape).alias("escape"))


class Model:
    """Contexts as a trie over the bytes read backwards, and log10 probabilities of all bytes in each."""

    def __init__(self, length: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        first = np.ones(len(length), bool)
        first[1:] = (length[1:] != length[:-1]) | (context[1:] != context[:-1])
        node = np.cumsum(first) - 1
        lengths, contexts = length[first], context[first]
        if not len(lengths) or lengths[0]:  # nothing learned
            lengths, contexts, node = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        size = len(lengths)
        self.depth = lengths.astype(np.int32)
        place = {(k, c): i for i, (k, c) in enumerate(zip(lengths.tolist(), contexts.tolist()))}
        parents = np.array([place[k - 1, c & ((1 << 8 * (k - 1)) - 1)] if k else 0 for k, c in place], np.int64)
        inner = np.unique(parents[1:])
        self.row = np.zeros(size, np.int32)  # row 0: a context without longer ones
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.longer = np.zeros((len(inner) + 1, 256), np.int32)  # 0: none
        oldest = contexts[1:] >> (8 * (lengths[1:] - 1))
        self.longer[self.row[parents[1:]], oldest] = np.arange(1, size)
        totals = np.bincount(node, n, size)
        longer = np.bincount(parents[1:], totals[1:], size)
        #: No longer context of the run was seen, unless it is here.
        self.whole = (self.depth == ORDER) | (longer == totals)
        self.log10 = np.empty((size, 256), np.float32)
        ends = np.searchsorted(node, np.arange(size + 1))
        step = 4096
        for k in range(int(lengths[-1]) + 1):
            low, high = np.searchsorted(lengths, [k, k + 1])
            for start in range(low, high, step):
                stop = min(start + step, high)
                own = slice(ends[start], ends[stop])
                above = 10.0 ** self.log10[parents[start:stop]].astype(np.float64) if k else np.full((stop - start, 256), 1 / 256)
                self.log10[start:stop] = np.log10(self._predict(above, node[own] - start, symbol[own], n[own]))

    @staticmethod
    def _predict(above: np.ndarray, node: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> np.ndarray:
        seen = np.zeros(above.shape)
        seen[node, symbol] = n
        total = seen.sum(1, keepdims=True)
        kinds = (seen > 0).sum(1, keepdims=True)
        rest = np.where(seen > 0, 0.0, above)
        left = rest.sum(1, keepdims=True)
        escape = np.where(total > 0, kinds / np.maximum(2 * total, 1), 1.0)
        escape = np.where(left > 0, escape, 0.0)
        own = (2 * seen - 1) / np.maximum(2 * total, 1)
        own = np.where(left > 0, own, seen / np.maximum(total, 1))
        return np.where(seen > 0, own, rest * escape / np.where(left > 0, left, 1.0))

    def scores(self, streams: list[bytes]) -> np.ndarray:
        """log10 probability of each stream, the padding aside, by a model that has all contexts."""
        return np.concatenate([sums for sums, *_ in self.settled(streams)]) if streams else np.zeros(0)

    def settled(self, streams: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """Per block of streams, which bounds the memory: log10 probability of each stream's settled positions; of
        the open ones the stream's number, the run and how often it is there."""
        before = 0
        for part in _blocks(streams):
            sums, at, runs, times = self._settled(part)
            yield sums, at + before, runs, times
            before += len(part)

    def nodes(self, runs: np.ndarray) -> np.ndarray:
        """The longest context that the trie has, per run."""
        node = np.zeros(len(runs), np.int32)
        going = np.arange(len(runs))
        for back in range(1, ORDER + 1):
            following = self.longer[self.row[node[going]], runs[going] >> 8 * back & 255]
            found = following > 0
            going = going[found]
            node[going] = following[found]
            if not len(going):
                break
        return node

    def _settled(self, streams: list[bytes]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(streams), np.uint8)
        starts = np.cumsum([0, *map(len, streams)])[:-1]
        pads = (starts[:, None] + np.arange(ORDER)).ravel()
        inside = np.ones(len(data), bool)
        inside[pads] = False
        total = np.zeros(len(data))
        places, open_runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin in range(ORDER, len(data), 1 << 16):
            stop = min(begin + (1 << 16), len(data))
            runs = contexts_of(data[begin - ORDER : stop])
            node = self.nodes(runs)
            whole = self.whole[node]
            total[begin:stop] = np.where(whole, self.log10[node, data[begin:stop]], 0.0)
            left = np.flatnonzero(~whole & inside[begin:stop])
            places.append(left + begin)
            open_runs.append(runs[left])
        total[pads] = 0.0
        at, runs = np.searchsorted(starts, np.concatenate(places), "right") - 1, np.concatenate(open_runs)
        order = np.lexsort((runs, at))
        at, runs = at[order], runs[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(at), 1), bool), (at[1:] != at[:-1]) | (runs[1:] != runs[:-1])]))
        return np.add.reduceat(total, starts), at[first], runs[first], np.diff(np.append(first, len(at)))


def _blocks(streams: list[bytes], most: int = CHUNK) -> Iterator[list[bytes]]:
    part, size = [], 0
    for x in streams:
        if part and size + len(x) > most:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part


def _model(sent) -> tuple[Model, dict[bytes, int]]:
    counts, words, numbers = sent.value
    key = zlib.crc32(counts[3].tobytes(), zlib.crc32(words))
    if key not in _models:
        _models.clear()
        known = words.split(b" ") if words else []
        _models[key] = Model(*counts), dict(zip(known, numbers.tolist()))
    return _models[key]


def lm_scores(
    docs: DataFrame, key: str = "doc_id", text: str = "text", contexts: int = CONTEXTS, frequent: int = FREQUENT
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Null and empty texts are their end alone. A null id is never held out. Repeated rows are trained
    on and scored as often as they are there. Without training documents all counts are 0 and the
    model is the even distribution. Other columns are not read.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    read = read.withColumn("held_out", held_out(F.col("doc_id")))
    counts = staged(training_counts(read.where("not held_out")), "counts")
    words = counts.where("word IS NOT NULL").select("word", "n")
    ends = counts.where("word IS NULL AND run IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kinds, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, vocabulary = total + ends, kinds + (ends > 0)
    short = words.where(F.octet_length("word") <= FREQUENT_BYTES)
    table_rows = short.where(F.col("n") >= most_frequent(short, frequent)).toArrow()
    model, others = context_counts(counts.where("run IS NOT NULL").select("run", "n"), contexts)
    sent = spark.sparkContext.broadcast(
        (model, b" ".join(table_rows.column("word").to_pylist()), table_rows.column("n").to_numpy())
    )
    return _scored(read, words, others, sent, int(tokens), int(vocabulary), int(ends))


def run_scores(runs: DataFrame, others: DataFrame, sent) -> DataFrame:
    """``run, value``: log10 probability of the last byte of each distinct run by all contexts."""
    schema = [("run", pa.int64()), ("depth", pa.int32()), ("value", pa.float64())]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, _ = _model(sent)
            own = batch.column(0).to_numpy()
            node = model.nodes(own)
            yield table(schema, own, model.depth[node], model.log10[node, own & 255].astype(np.float64))

    known = map_partition(runs, short, "run long, depth int, value double")
    each = known.select("*", F.explode(F.sequence(F.col("depth") + 1, F.lit(ORDER))).alias("length"))
    each = each.withColumn("context", F.expr("shiftright(run, 8) & (shiftleft(1L, 8 * length) - 1)"))
    found = each.join(others, ["length", "context"], "left")
    n = F.col("seen")[F.col("run").bitwiseAND(F.lit(255)).cast("int")]
    own = F.log10((2 * n - 1) / (2 * F.col("total")))
    steps = found.groupBy("run").agg(
        F.first("value").alias("value"),
        F.sort_array(F.collect_list(F.when(F.col("total").isNotNull(), F.struct("length", own.alias("own"), "escape")))).alias("steps"),
    )
    value = F.aggregate("steps", F.col("value"), lambda value, step: F.coalesce(step["own"], value + step["escape"]))
    return steps.select("run", value.alias("value"))


def _scored(read: DataFrame, words: DataFrame, others: DataFrame, sent, tokens: int, vocabulary: int, ends: int) -> DataFrame:
    below = tokens + vocabulary + 1
    schema = [
        ("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
        ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()),
        ("run", pa.int64()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, row = task(), 0
        for batch in batches:
            model, known = _model(sent)
            streams, rows, rare = [], [], []
            for doc_id, out, text in zip(column(batch, "doc_id"), column(batch, "held_out"), blobs(batch, "text")):
                own = text.lower().split()
                streams.append(stream(own))
                base, seen = math.log10((ends + 1) / below), int(ends > 0)
                for word, n in Counter(own).items():
                    c = known.get(word)
                    if c is None:
                        rare.append((row, n, word))
                    else:
                        base += n * math.log10((c + 1) / below)
                        seen += n
                rows.append((here, row, doc_id, out, len(own) + 1, seen, base))
                row += 1
            sums = []
            for settled, at, runs, times in model.settled(streams):
                sums.append(settled)
                if len(at):
                    empty = [pa.nulls(len(at), kind) for _, kind in schema]
                    yield table(schema, np.full(len(at), here, np.int32), at + rows[0][1], *empty[2:4], times, *empty[5:9], runs)
            empty = [None] * len(rows)
            yield table(schema, *map(list, zip(*rows)), np.concatenate(sums), empty, empty)
            if rare:
                at, n, word = map(list, zip(*rare))
                empty = [None] * len(rare)
                yield table(schema, [here] * len(rare), at, empty, empty, n, empty, empty, empty, word, empty)

    made = staged(
        map_partition(read, run, "part int, row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, word binary, run long"),
        "scored",
    )
    rare = made.where("word IS NOT NULL").select("part", "row", "word", F.col("n_tokens").alias("times"))
    found = rare.join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = found.groupBy("part", "row").agg(
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(below))).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"),
    )
    opened = made.where("run IS NOT NULL").select("part", "row", "run", F.col("n_tokens").alias("times"))
    values = run_scores(opened.select("run").distinct(), others, sent)
    longer = opened.join(values, "run").groupBy("part", "row").agg(F.sum(F.col("times") * F.col("value")).alias("longer"))
    rows = made.where("word IS NULL AND run IS NULL").drop("word", "run").join(sums, ["part", "row"], "left").join(longer, ["part", "row"], "left")
    return rows.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("longer", F.lit(0.0))).alias("score"),
    )
