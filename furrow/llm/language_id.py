"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` bytes, each from both ends; every position gets a
probability for each language from the two states that meet there, and a text's probabilities are
the means over all its positions. The gates are piecewise linear, which numpy evaluates quickly.

The network is trained on the driver by backpropagation through time. It sees a bounded sample: of
each language at most about ``per_language`` documents, chosen by hash, and of each of these
``PER_DOCUMENT`` windows, anywhere in the text. Prediction is a map over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.texts import blobs, column, map_batches, table

WINDOW = 128
STATES = 8
PER_LANGUAGE = 600
PER_DOCUMENT = 4
#: Languages that are learned; rarer ones beyond these are not.
MOST_LANGUAGES = 256
TRAINING_STEPS = 240
BATCH = 192
LETTER = re.compile(r"[^\W\d_]")
#: Windows that are evaluated together.
BLOCK = 2048
UNDETERMINED = "und"


def held_out(key: Column, parts: int = 5, part: int = 0) -> Column:
    """The documents that are kept from training: crc32 of the id as text."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


class Direction:
    """One reading direction: input rows per byte (3 gates), recurrent weights and bias."""

    def __init__(self, random: np.random.Generator, states: int):
        self.states = states
        self.rows = random.normal(0, 0.3, (256, 3 * states)).astype(np.float32)
        self.weights = random.normal(0, 0.4 / np.sqrt(states), (states, 3 * states)).astype(np.float32)
        self.bias = np.zeros(3 * states, np.float32)
        self.bias[:states] = 1.0  # at first, states are kept for long

    def parameters(self) -> list[np.ndarray]:
        return [self.rows, self.weights, self.bias]

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Update and reset gates, candidate, its recurrent part and the new state."""
        n = self.states
        a = h @ self.weights
        a += self.bias
        gates = x[:, : 2 * n] + a[:, : 2 * n]
        gates *= np.float32(0.25)
        gates += np.float32(0.5)
        np.minimum(gates, np.float32(1), out=gates)
        np.maximum(gates, np.float32(0), out=gates)
        z, r = gates[:, :n], gates[:, n:]
        candidate = r * a[:, 2 * n :]
        candidate += x[:, 2 * n :]
        np.minimum(candidate, np.float32(1), out=candidate)
        np.maximum(candidate, np.float32(-1), out=candidate)
        new = h - candidate
        new *= z
        new += candidate
        return z, r, candidate, a, new

    def read(self, data: np.ndarray, there: np.ndarray | None) -> np.ndarray:
        """States after each of the rows of ``data`` (time first)."""
        h = np.zeros((data.shape[1], self.states), np.float32)
        found = np.empty((*data.shape, self.states), np.float32)
        for t in range(len(data)):
            h = self.step(self.rows.take(data[t], axis=0), h)[4]
            if there is not None:
                h *= there[t][:, None]
            found[t] = h
        return found

    def learn(self, data: np.ndarray, there: np.ndarray, back) -> list[np.ndarray]:
        """Gradients by backpropagation through time; ``back`` gives those of the states."""
        n, size = self.states, data.shape[1]
        h = np.zeros((size, n), np.float32)
        kept, states = [], np.empty((*data.shape, n), np.float32)
        for t in range(len(data)):
            z, r, candidate, a, new = self.step(self.rows[data[t]], h)
            new *= there[t][:, None]
            kept.append((z, r, candidate, a, h))
            states[t] = h = new
        outer = back(states)
        rows = np.empty((*data.shape, 3 * n), np.float32)
        weights, bias = np.zeros_like(self.weights), np.zeros_like(self.bias)
        dh = np.zeros((size, n), np.float32)
        for t in range(len(data) - 1, -1, -1):
            z, r, candidate, a, before = kept[t]
            dh = (dh + outer[t]) * there[t][:, None]
            dc = dh * (1 - z) * (np.abs(candidate) < 1)
            dz = dh * (before - candidate) * ((z > 0) & (z < 1)) * np.float32(0.25)
            dr = dc * a[:, 2 * n :] * ((r > 0) & (r < 1)) * np.float32(0.25)
            da = np.concatenate([dz, dr, dc * r], 1)
            rows[t] = np.concatenate([dz, dr, dc], 1)
            weights += before.T @ da
            bias += da.sum(0)
            dh = dh * z + da @ self.weights.T
        by_byte = np.zeros_like(self.rows)
        np.add.at(by_byte, data.ravel(), rows.reshape(-1, 3 * n))
        return [by_byte, weights, bias]


class Network:
    """Two directions and a softmax over the languages at every position."""

    def __init__(self, languages: list[str], states: int = STATES, seed: int = 5):
        random = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.behind = Direction(random, states), Direction(random, states)
        self.out = random.normal(0, 0.3, (2 * states, len(languages))).astype(np.float32)
        self.base = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.behind.parameters(), self.out, self.base]

    def positions(self, data: np.ndarray, there: np.ndarray | None) -> np.ndarray:
        """Probabilities (time, window, language)."""
        n = self.ahead.states
        logits = self.ahead.read(data, there) @ self.out[:n]
        logits += self.behind.read(data[::-1], None if there is None else there[::-1])[::-1] @ self.out[n:]
        logits += self.base
        return _softmax(logits)

    def gradients(self, data: np.ndarray, there: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        n = self.ahead.states
        states = np.concatenate([self.ahead.read(data, there), self.behind.read(data[::-1], there[::-1])[::-1]], 2)
        chance = _softmax(states @ self.out + self.base)
        total = there.sum()
        own = chance[:, np.arange(data.shape[1]), labels]
        loss = float(-(np.log(own + 1e-9) * there).sum() / total)
        chance[:, np.arange(data.shape[1]), labels] -= 1
        chance *= (there / total)[:, :, None].astype(np.float32)
        flat = chance.reshape(-1, chance.shape[2])
        inner = chance @ self.out.T
        ahead = self.ahead.learn(data, there, lambda _: inner[:, :, :n])
        behind = self.behind.learn(data[::-1], there[::-1], lambda _: inner[::-1, :, n:])
        return loss, [*ahead, *behind, states.reshape(len(flat), -1).T @ flat, flat.sum(0)]

    def train(self, windows: list[bytes], labels: list[int], steps: int = TRAINING_STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 9) -> list[float]:
        """Adam over shuffled batches in which every language has the same share; returns the losses."""
        random = np.random.default_rng(seed)
        by_label = [np.flatnonzero(np.array(labels) == k) for k in range(len(self.languages))]
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        losses = []
        for step in range(1, steps + 1):
            chosen = np.array([random.choice(by_label[k]) for k in random.integers(0, len(by_label), batch)])
            data, there = layout([windows[i] for i in chosen])
            loss, found = self.gradients(data, there, np.array(labels)[chosen])
            losses.append(loss)
            size = np.sqrt(sum(float((g * g).sum()) for g in found))
            slow = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(self.parameters(), found, first, second):
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return losses

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text; zeros for an empty one."""
        counts = [-(-len(x) // WINDOW) for x in texts]
        owner = np.repeat(np.arange(len(texts)), counts)
        data = np.frombuffer(b"".join([x.ljust(c * WINDOW, b"\0") for x, c in zip(texts, counts)]), np.uint8).reshape(-1, WINDOW)
        lengths = np.full(len(owner), WINDOW)
        ends = np.cumsum(counts)
        for i, x in enumerate(texts):
            if len(x) % WINDOW:
                lengths[ends[i] - 1] = len(x) % WINDOW
        sums = np.zeros((len(texts), len(self.languages)))
        for whole in (True, False):  # windows that are full need no mask
            at = np.flatnonzero((lengths == WINDOW) == whole)
            for start in range(0, len(at), BLOCK):
                own = at[start : start + BLOCK]
                part = np.ascontiguousarray(data[own].T)
                there = None if whole else (np.arange(WINDOW)[:, None] < lengths[own]).astype(np.float32)
                chance = self.positions(part, there)
                if there is not None:
                    chance *= there[:, :, None]
                np.add.at(sums, owner[own], chance.sum(0))
        return sums / np.maximum(np.array([len(x) for x in texts]), 1)[:, None]


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def layout(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and mask, time first."""
    data = np.frombuffer(b"".join(x.ljust(WINDOW, b"\0") for x in windows), np.uint8).reshape(-1, WINDOW)
    there = np.arange(WINDOW)[:, None] < np.array([len(x) for x in windows])
    return np.ascontiguousarray(data.T), there.astype(np.float32)


def training_windows(docs: DataFrame, per_language: int) -> tuple[list[str], list[bytes], list[int]]:
    """Languages and a bounded sample of labelled windows from ``doc_id, text, lang``."""
    counts = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").groupBy("lang").agg(F.count("*").alias("n"))
    rows = counts.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the network has no place for all of them")
    languages = sorted(row["lang"] for row in rows)
    share = {row["lang"]: per_language / row["n"] for row in rows}
    kind = F.create_map(*[F.lit(x) for pair in share.items() for x in pair]) if share else F.create_map()
    drawn = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / F.lit(1_000_003)) < F.coalesce(kind[F.col("lang")], F.lit(0.0))
    schema = [("lang", pa.string()), ("window", pa.binary())]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for lang, text in zip(column(batch, "lang"), blobs(batch, "text")):
            for i in range(PER_DOCUMENT):
                at = xxhash.xxh64_intdigest(text, i) % max(1, len(text) - WINDOW + 1)
                found.append((lang, text[at : at + WINDOW]))
        return table(schema, *map(list, zip(*found)))

    chosen = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").where(drawn) if share else docs.limit(0)
    most = 2 * PER_DOCUMENT * per_language * max(1, len(languages))
    found = map_batches(chosen.select("lang", "text"), each, "lang string, window binary")
    # about half of the bound is drawn; should it be more, the same windows go on every run
    found = found.orderBy(F.xxhash64("lang", "window"), "lang", "window").limit(most).toArrow().to_pydict()
    # Rows arrive in the order of tasks; sorted, training does not depend on it.
    pairs = sorted(zip(found["lang"], found["window"]))
    return languages, [bytes(x) for _, x in pairs], [languages.index(x) for x, _ in pairs]


def trained(docs: DataFrame, per_language: int = PER_LANGUAGE, steps: int = TRAINING_STEPS) -> Network:
    """A network for the languages of ``doc_id, text, lang``; without labelled texts it knows none."""
    languages, windows, labels = training_windows(docs, per_language)
    network = Network(languages)
    if len(set(labels)) > 1:
        network.train(windows, labels, steps)
    return network


def identify(
    docs: DataFrame,
    network: Network | None = None,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    carry: list[str] | None = None,
) -> DataFrame:
    """``row, lang_pred, score``; ``row`` holds the columns ``carry`` of ``docs``, by default all.

    The network learns from rows with text and label that are not held out. ``und`` with score 0
    stands for null texts, texts without a letter, and for all texts if nothing was learned. Texts
    are read whole; equal probabilities go to the first language in order. Repeated rows are
    predicted each; an empty table gives an empty result.
    """
    read = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    if network is None:
        network = trained(read.where(~held_out(F.col("doc_id"))), per_language)
    sent = docs.sparkSession.sparkContext.broadcast(network)
    ready = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = sent.value
        texts = column(batch, "text")
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        asked = [i for i, x in enumerate(texts) if x and model.languages and LETTER.search(x)]
        for part in _blocks(asked, texts):
            chance = model.predict([texts[i].encode() for i in part])
            for i, k, p in zip(part, chance.argmax(1), chance.max(1)):
                names[i], scores[i] = model.languages[k], float(p)
        schema = [("row", batch.schema.field(0).type), ("lang_pred", pa.string()), ("score", pa.float64())]
        return table(schema, batch.column(0), names, [min(1.0, max(0.0, x)) for x in scores])

    kind = ready.schema["row"].dataType.simpleString()
    return map_batches(ready, each, f"row {kind}, lang_pred string, score double")


def _blocks(asked: list[int], texts: list[str], most: int = 1 << 20) -> Iterator[list[int]]:
    part, size = [], 0
    for i in asked:
        part.append(i)
        size += len(texts[i])
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part
