"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features are densities of a learned and of a general lexicon, hits near a second person, capitals,
punctuation and obfuscation. Lexicon and trees learn from one part of a bounded sample of labelled texts, the
calibration from the rest. Words are folded before they meet the lexicon: lower case, digits and signs that
stand for letters, stretched letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.texts import blobs, column, map_batches, staged, table
from furrow.session import checkpoint_root

#: Labelled documents of each label that are learned from at most (about; by a hash of their id).
PER_LABEL = 20_000
#: One training text in so many calibrates.
CALIBRATES = 4
TREES, DEPTH, STEP = 20, 3, 0.3
#: Entries that are looked at for the lexicon, and letters of its word beginnings.
CANDIDATES = 4_000
STEM = range(3, 13)
#: A toxic text is explained when so many entries of the lexicon are found in it.
COVER = 2
#: Words whose class a worker remembers.
CACHE = 1 << 19
NEAR = 5

# Letters that digits and signs stand for, general insults, words for the second person.
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb scum pathetic worthless disgusting loser losers trash clown fool jerk bastard bitch"
    " dummkopf trottel arschloch abschaum wertlos ekelhaft versager blödmann hurensohn"
    " idiote crétin connard salaud ordure pathétique abruti débile pute"
    " idiota imbécil estúpido estúpida basura asqueroso patético inútil perdedor".split()
)
YOU = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner euch euer tu toi vous votre vos tes tú ti usted ustedes tus vosotros".split()
)

FEATURES = [
    "lexicon", "lexicon_entries", "insults", "near_you", "near_you_share", "you", "capitals", "capital_words", "exclamations",
    "questions", "punctuation", "symbols", "digits", "obfuscated", "obfuscated_hits", "stretched", "words",
]
HIT, INSULT, SECOND, SHOUT, OBFUSCATED, STRETCHED = 1, 2, 4, 8, 16, 32
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_TABLE = str.maketrans(LOOKS_LIKE)


def folded(word: str) -> tuple[str, bool, bool]:
    """Letters meant by a word, whether signs or digits hide some, whether letters are stretched."""
    core = _EDGES.sub("", word.lower())
    hidden = False
    if not core.isalpha():
        plain = core.replace("'", "").replace("’", "").replace("-", "")
        if not plain.isalpha():
            if not any(x.isalpha() for x in plain):
                return core, False, False
            hidden = True
            plain = "".join(x for x in plain.translate(_TABLE) if x.isalpha())
        core = plain
    short = _STRETCHED.sub(r"\1", core)
    return short, hidden, short != core


def entries(word: str) -> list[str]:
    """Beginnings of a folded word, and the whole word with an end mark."""
    return [word[:k] for k in STEM if k <= len(word)] + [word + "$"]


class Describer:
    """Dense features of texts for a lexicon of word beginnings and whole words."""

    def __init__(self, lexicon: Iterable[str]):
        self.number = {entry: i for i, entry in enumerate(sorted(lexicon))}
        self.seen: dict[bytes, tuple[int, int]] = {}

    def __getstate__(self) -> dict:
        return {"number": self.number, "seen": {}}

    def classify(self, word: bytes) -> tuple[int, int]:
        """Flags of a word and the number of its entry, -1 without one."""
        text = word.decode()
        core, hidden, stretched = folded(text)
        found = next((self.number[e] for e in reversed(entries(core)) if e in self.number), -1)
        flags = (HIT if found >= 0 else 0) | (INSULT if core in INSULTS else 0) | (SECOND if core in YOU else 0)
        shout = len(core) > 1 and text.isupper()
        flags |= (SHOUT if shout else 0) | (OBFUSCATED if hidden else 0) | (STRETCHED if stretched else 0)
        if len(self.seen) < CACHE:
            self.seen[word] = flags, found
        return flags, found

    def describe(self, text: bytes) -> list[float]:
        words = text.split()
        n = max(len(words), 1)
        known = self.seen.get
        each = [known(w) or self.classify(w) for w in words]
        flags = np.fromiter((f for f, _ in each), np.uint8, len(words))
        hits = (flags & (HIT | INSULT)) > 0
        at, you = np.flatnonzero(hits), np.flatnonzero(flags & SECOND)
        near = 0
        if len(at) and len(you):
            right = np.minimum(np.searchsorted(you, at), len(you) - 1)
            near = int((np.minimum(np.abs(you[right] - at), np.abs(at - you[np.maximum(right - 1, 0)])) <= NEAR).sum())
        found = len({e for _, e in each if e >= 0}) if len(at) else 0
        count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        size = max(len(text), 1)

        def share(flag: int) -> float:
            return 100 * int((flags & flag > 0).sum()) / n

        def signs(which: bytes) -> float:
            return 100 * int(count[list(which)].sum()) / size

        letters = max(int(count[65:91].sum() + count[97:123].sum()), 1)
        return [
            share(HIT), float(found), share(INSULT), 100 * near / n, near / max(len(at), 1), share(SECOND),
            100 * int(count[65:91].sum()) / letters, share(SHOUT), signs(b"!"), signs(b"?"), signs(b".,;:'\"()-"),
            signs(b"#$%&*|<>@^~"), signs(b"0123456789"), share(OBFUSCATED), 100 * int((hits & (flags & OBFUSCATED > 0)).sum()) / n,
            share(STRETCHED), float(np.log1p(len(words))),
        ]


@dataclass
class Model:
    """What was learned: without trees every text gets ``base``, the share of toxic labels."""

    lexicon: list[str]
    base: float = 0.0
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """``text, toxic, weight, fits`` of a bounded sample of labelled documents, equal texts once.

    ``docs`` has ``doc_id, text``, ``labels`` ``doc_id, toxic``; ids that are held out or null are left out, an id
    with several labels is toxic if one says so, an id with several texts gives one of them. The sample is
    drawn by a hash of the id per label; ``weight`` undoes its shares.
    """
    ids = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    counts = {row["toxic"]: row["n"] for row in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for toxic, n in counts.items():
        share = F.when(F.col("toxic") == toxic, min(1.0, per_label / n)).otherwise(share)
    drawn = ids.withColumn("share", share).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    rows = docs.where("text <> ''").join(F.broadcast(drawn), "doc_id")
    one = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("share").alias("share"), F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = one.groupBy("text").agg(F.max("toxic").alias("toxic"), F.sum(1 / F.col("share")).alias("weight"))
    return texts.select("text", "toxic", "weight", (F.pmod(F.xxhash64("text"), F.lit(CALIBRATES)) != 0).alias("fits"))


def learned_lexicon(texts: DataFrame) -> list[str]:
    """Entries that explain the toxic ones of ``text, toxic`` and are rare in the others.

    Entries are chosen one after the other: each must be found in several toxic texts that fewer than
    ``COVER`` chosen ones explain, so the common words of a family of near copies add nothing.
    """
    totals = {row["toxic"]: row["n"] for row in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return []
    bad, good = totals[1.0], totals[0.0]
    least = max(3, bad // 200)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {0.0: Counter(), 1.0: Counter()}
        for data, toxic in zip(blobs(batch, "text"), column(batch, "toxic")):
            found[toxic].update({e for w in {folded(x)[0] for x in data.decode().split()} if w for e in entries(w)})
        names = list(found[0.0].keys() | found[1.0].keys())
        schema = [("entry", pa.string()), ("bad", pa.int64()), ("good", pa.int64())]
        return table(schema, names, [found[1.0][x] for x in names], [found[0.0][x] for x in names])

    counts = map_batches(texts.select("text", "toxic"), count, "entry string, bad long, good long").groupBy("entry").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    odds = F.log((F.col("bad") + 0.5) / (bad + 1) * (good + 1) / (F.col("good") + 0.5))
    sure = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    asked = counts.where(F.col("bad") >= least).withColumn("sure", sure).where((odds > 2.5) & (F.col("sure") > 2.5))
    top = asked.orderBy(F.desc("sure"), "entry").limit(CANDIDATES).select("entry", "good").collect()
    if not top:
        return []
    number = {row["entry"]: i for i, row in enumerate(top)}

    def where(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            sorted({number[e] for w in {folded(x)[0] for x in data.decode().split()} for e in entries(w) if e in number})
            for data in blobs(batch, "text")
        ]
        return table([("found", pa.list_(pa.int32()))], found)

    explained = map_batches(texts.where("toxic = 1").select("text"), where, "found array<int>").collect()
    return chosen([row["entry"] for row in top], [row["good"] for row in top], [row["found"] for row in explained], least)


def chosen(names: list[str], good: list[int], found: list[list[int]], least: int) -> list[str]:
    """Greedy cover of the texts ``found`` by entries, each text ``COVER`` times; equal gains go to the longest entry."""
    holds: list[list[int]] = [[] for _ in names]
    for text, hits in enumerate(found):
        for entry in hits:
            holds[entry].append(text)
    gain = [len(x) for x in holds]
    need = [COVER] * len(found)
    open_ = set(range(len(names)))
    lexicon: list[str] = []
    while open_:
        best = max(open_, key=lambda e: (gain[e], -good[e], len(names[e].rstrip("$")), not names[e].endswith("$"), names[e]))
        if gain[best] < least:
            break
        name = names[best].rstrip("$")
        lexicon.append(names[best])
        for text in holds[best]:
            need[text] -= 1
            if need[text] == 0:
                for entry in found[text]:
                    gain[entry] -= 1
        # beginnings and continuations are found in the same words
        open_ = {e for e in open_ if not (names[e].rstrip("$").startswith(name) or name.startswith(names[e].rstrip("$")))}
    return sorted(lexicon)


def described(docs: DataFrame, lexicon: Iterable[str], carry: list[str]) -> DataFrame:
    """``row`` with the columns ``carry`` and the vector ``features`` of ``text``."""
    describer = Describer(lexicon)
    sent = docs.sparkSession.sparkContext.broadcast(describer)
    ready = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("text"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = sent.value
        schema = [("row", batch.schema.field(0).type), ("features", pa.list_(pa.float64()))]
        return table(schema, batch.column(0), [model.describe(x) for x in blobs(batch, "text")])

    made = map_batches(ready, each, f"row {ready.schema['row'].dataType.simpleString()}, features array<double>")
    return made.select("row", array_to_vector("features").alias("features"))


def margin() -> Column:
    return F.round(vector_to_array("rawPrediction")[1], 3)


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model from ``doc_id, text`` and ``doc_id, toxic``; see ``training_texts`` for what counts."""
    checkpoint_root(docs.sparkSession)  # boosting cuts its lineage there
    texts = staged(training_texts(docs, labels, per_label), "toxic-texts")
    seen = {row["toxic"]: row["w"] for row in texts.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
    base = seen.get(1.0, 0.0) / max(sum(seen.values()), 1.0)
    if len(seen) < 2:
        return Model([], base)
    parts = {(row["fits"], row["toxic"]) for row in texts.select("fits", "toxic").distinct().collect()}
    split = len(parts) == 4  # with very few texts one part may miss a label: then all of them do both
    lexicon = learned_lexicon(texts.where("fits") if split else texts)
    rows = described(texts.coalesce(16), lexicon, ["toxic", "weight", "fits"]).select("row.*", "features")
    rows = staged(rows, "toxic-features").coalesce(4)
    trees = GBTClassifier(
        featuresCol="features", labelCol="toxic", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=42
    ).fit(rows.where("fits") if split else rows)
    judged = trees.transform(rows.where("NOT fits") if split else rows).select(margin().alias("margin"), "toxic", "weight")
    steps = judged.groupBy("margin").agg((F.sum(F.col("toxic") * F.col("weight")) / F.sum("weight")).alias("toxic"), F.sum("weight").alias("weight"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="toxic", weightCol="weight").fit(steps.coalesce(1))
    return Model(lexicon, base, trees, calibration)


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row, score``: the calibrated chance of a toxic label for every text.

    ``row`` holds the columns ``carry`` of ``docs``, by default all. A null text is empty, and an empty text is
    scored by its features like any other. Texts are read whole and each by itself, so equal texts have
    equal scores; an empty table gives an empty one.
    """
    kept = docs.columns if carry is None else carry
    ready = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    if model.trees is None:
        return ready.select("row", F.lit(float(model.base)).alias("score"))
    rows = described(ready, model.lexicon, ["row"]).select("row.row", "features")
    judged = model.calibration.setPredictionCol("chance").transform(model.trees.transform(rows).select("row", margin().alias("margin")))
    return judged.select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "chance")).alias("score"))
