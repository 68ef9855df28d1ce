"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is the composition of
  * the normaliser: a blank before a text that is not empty, blanks as U+2581;
  * the pieces, as a trie whose arcs read characters and write a piece's id, with weight minus its
    score;
  * byte fallback: a character that is no piece is read as the ids of its UTF-8 bytes.
A text composed with it is a lattice of positions; its encoding is the shortest path in the
tropical semiring (weights add up along a path, the least path wins). For unigram models that is
all. For merge models (BPE) the path also goes through an acceptor of piece pairs: two pieces may
follow each other only if merging their characters gives back those two pieces; all other pairs
weigh infinitely much. A sequence with only such pairs is the merge result of its text, so exactly
one path of finite weight is left, and at every position one state at most can be reached. The
composition is therefore expanded lazily, the longest piece first, and a state is left for good
once no piece leads on from it.

The pieces are compiled into a trie whose nodes are the states of the transducer inside a piece.

No piece crosses from another character to a blank or between letters and others, or holds a line
end (checked when a model is compiled), so the shortest path of a text is put together from those
of its blank-led runs, which workers keep in a bounded cache. Decoding runs the transducer backwards.
"""

from __future__ import annotations

import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.texts import blobs, column, kept_by_worker, keyed, map_batches, no_cycle_search, shared_file, table

BLANK = "\u2581"
#: A line end, or blanks with the letters or the other characters after them; \u00b2 and its like are no letters.
LETTERS = "[^\\W\\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+"
OTHERS = f"(?:[^\\w {BLANK}\n]|[\\d_\u00b2\u00b3\u00b9\u00bc-\u00be])+"
WORD = re.compile(f"\n|[ {BLANK}]+(?:{LETTERS}|{OTHERS})?|{LETTERS}|{OTHERS}")
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, MERGES = 1, 2
#: What a unigram model's unknown character costs over the worst piece.
UNKNOWN_COST = 10.0
CACHE_SIZE = 800_000
KEPT_CHARS = 48
PAIR_CACHE_SIZE = 1_000_000


class Transducer(dict):
    """Ids of blank-led runs as bytes of little-endian 32-bit numbers; see the module text."""

    def __init__(self, content: bytes):
        super().__init__()
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(content)
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that leave characters and blanks as they are")
        if model.trainer_spec.model_type not in (UNIGRAM, MERGES) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and merge models with blanks before words")
        self.prefix = " " if rules.add_dummy_prefix else ""
        self.merges = model.trainer_spec.model_type == MERGES
        self.scores = np.array([p.score for p in model.pieces], np.float64)
        self.piece = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        if any(WORD.fullmatch(p) is None for p in self.piece):
            raise ValueError("a piece crosses words")
        self.trie = self._trie()
        self.worst = float(self.scores.min(initial=0.0)) - UNKNOWN_COST
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple[set[str], set[str]] | None] = {}
        self.long: list[str] = []
        self.surface = [self._surface(p, model.trainer_spec.unk_surface) for p in model.pieces]

    def _trie(self) -> dict:
        """Nodes by character; a piece that ends at a node is there under the empty string."""
        root: dict = {}
        for piece in self.piece:
            node = root
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = piece
        return root

    @staticmethod
    def _surface(piece, unknown: str) -> bytes:
        if piece.type == BYTE:
            return bytes([int(piece.piece[3:5], 16)])
        if piece.type == UNKNOWN:
            return unknown.encode()
        return piece.piece.replace(BLANK, " ").encode() if piece.type in (NORMAL, USER) else b""

    # --- the acceptor of piece pairs

    def merged(self, symbols: list[str]) -> list[list[str]]:
        """All stages of merging, the best scored pair first and the leftmost of equals."""
        stages = [symbols]
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                number = self.piece.get(symbols[i] + symbols[i + 1])
                if number is not None and (best is None or self.scores[number] > best):
                    best, at = self.scores[number], i
            if at < 0:
                return stages
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
            stages.append(symbols)

    def sides(self, piece: str) -> tuple[set[str], set[str]] | None:
        """What stands at the left and right end of a piece while it is merged; None if merging never makes it."""
        if piece not in self.edges:
            stages = self.merged(list(piece))
            whole = len(stages[-1]) == 1
            self.edges[piece] = ({s[0] for s in stages}, {s[-1] for s in stages}) if whole else None
        return self.edges[piece]

    def follows(self, first: str, second: str) -> bool:
        """Whether merging the characters of both gives back the two."""
        known = self.pairs.get((first, second))
        if known is None:
            a, b = self.sides(first), self.sides(second)
            if a is None or b is None:
                known = False
            elif not any(x + y in self.piece for x in a[1] for y in b[0]):
                known = True
            else:
                known = self.merged(list(first + second))[-1] == [first, second]
            if len(self.pairs) > PAIR_CACHE_SIZE:
                self.pairs.clear()
            self.pairs[first, second] = known
        return known

    # --- shortest paths

    def arcs(self, text: str, start: int) -> list[str]:
        """The pieces that can be read from ``start`` on, the shortest first; a character that is no piece is an arc, too."""
        node, found = self.trie, []
        for at in range(start, len(text)):
            node = node.get(text[at])
            if node is None:
                break
            piece = node.get("")
            if piece is not None:
                found.append(piece)
        if not found or len(found[0]) > 1:
            found.insert(0, text[start])
        return found

    def path(self, text: str) -> list[str]:
        """The pieces (or single unknown characters) on the least path through the lattice of ``text``."""
        return self.finite_path(text) if self.merges else self.least_path(text)

    def finite_path(self, text: str) -> list[str]:
        """The one path on which all neighbours may follow each other."""
        size = len(text)
        pairs, at = self.pairs, 0
        path: list[str] = []
        open_arcs = [self.arcs(text, 0)]
        reached = {0}
        while at < size:
            left = open_arcs[-1]
            if not left:
                open_arcs.pop()
                at -= len(path.pop())
                continue
            arc = left.pop()
            stop = at + len(arc)
            if stop in reached:
                continue
            if path:
                fits = pairs.get((path[-1], arc))
                if fits is None:
                    fits = self.follows(path[-1], arc)
            else:
                fits = self.sides(arc) is not None
            if fits:
                path.append(arc)
                reached.add(stop)
                at = stop
                if at < size:
                    open_arcs.append(self.arcs(text, at))
        return path

    def least_path(self, text: str) -> list[str]:
        """The path whose sum of weights is least; of equals the one found first."""
        size = len(text)
        cost = [0.0, *[np.inf] * size]
        last = [""] * (size + 1)
        for start in range(size):
            for arc in self.arcs(text, start):
                number = self.piece.get(arc)
                weight = -(self.worst if number is None else self.scores[number])
                stop = start + len(arc)
                if cost[start] + weight < cost[stop]:
                    cost[stop], last[stop] = cost[start] + weight, arc
        found, at = [], size
        while at:
            found.append(last[at])
            at -= len(last[at])
        return found[::-1]

    def __missing__(self, word: str) -> bytes:
        ids = []
        for arc in self.path(word.replace(" ", BLANK)):
            number = self.piece.get(arc)
            if number is not None:
                ids.append(number)
            elif self.bytes:
                ids += [self.bytes[x] for x in arc.encode()]
            else:
                ids.append(self.unknown)
        if len(self) > CACHE_SIZE:
            self.clear()
        made = np.array(ids, "<i4").tobytes()
        if len(word) <= KEPT_CHARS:
            self[word] = made
        return made

    def encode(self, text: str) -> bytes:
        """Ids of a text, 4 bytes each; none for an empty text."""
        return b"".join(map(self.__getitem__, WORD.findall(self.prefix + text))) if text else b""

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix and text.startswith(b" "):
            text = text[1:]
        return text.decode("utf-8", "replace")



_transducers: dict[int, Transducer] = kept_by_worker(__name__)


def _transducer(sent) -> Transducer:
    key = zlib.crc32(sent.value)
    if key not in _transducers:
        _transducers.clear()
        _transducers[key] = Transducer(sent.value)
    return _transducers[key]


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, ids, cost`` per row: ids of the least path and its weight.

    Null and empty texts have no ids and no cost. Repeated rows are encoded each; other columns are
    not read; an empty table gives an empty result.
    """
    sent = shared_file(docs.sparkSession, model_path)
    schema = [("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("cost", pa.float64())]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _transducer(sent)
        with no_cycle_search():
            found = [np.frombuffer(made.encode(x or ""), "<i4") for x in column(batch, "text")]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found), pa.int32()))
        return table(schema, batch.column(0), batch.column(1), ids, [-float(made.scores[x].sum()) + 0.0 for x in found])

    ready = keyed(docs, key, text).select(F.col("doc_id").cast("long"), "text")
    return map_batches(ready, each, "doc_id long, text string, ids array<int>, cost double")


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, decoded`` from ``doc_id, ids``; null ids are no ids. Ids must be of the model."""
    sent = shared_file(rows.sparkSession, model_path)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _transducer(sent)
        texts = [made.decode(ids.tolist()) for ids in _ids(batch.column(1))]
        return table([("doc_id", pa.int64()), ("decoded", pa.string())], batch.column(0), texts)

    return map_batches(rows.select("doc_id", "ids"), each, "doc_id long, decoded string")


def round_trip(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, cost, decoded_sha256, round_trip`` from the result of ``encode``.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers; ``round_trip`` says that
    decoding the ids gives the text (null as empty).
    """
    sent = shared_file(encoded.sparkSession, model_path)
    schema = [
        ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("cost", pa.float64()),
        ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()),
    ]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _transducer(sent)
        sizes, sums, digests, same = [], [], [], []
        for ids, text in zip(_ids(batch.column(1)), blobs(batch, "text")):
            decoded = made.decode(ids.tolist()).encode()
            sizes.append(len(ids))
            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            digests.append(sha256(decoded).hexdigest())
            same.append(decoded == text)
        return table(schema, batch.column(0), sizes, sums, batch.column(2), digests, same)

    return map_batches(
        encoded.select("doc_id", "ids", "cost", "text"), each,
        "doc_id long, n_ids long, ids_crc32 long, cost double, decoded_sha256 string, round_trip boolean",
    )


def _ids(lists: pa.Array) -> list[np.ndarray]:
    """The ids of every row, cut from the flat values; null is none."""
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if there else values[:0] for a, b, there in zip(ends, ends[1:], valid)]
