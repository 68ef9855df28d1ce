"""Merging of single runs for byte-level merge models: the ids that the model's own library gives a run, at a fraction of its time.

The library prepares every text (normaliser, pattern, offsets) before it merges, which costs far
more than merging one short run. Where a model's merges are numbered in their order, its
vocabulary is a table of ranks, and a merge by lowest rank of an already prepared run gives the
same ids. A model of another form has no such table, and callers keep to the library.
"""

from __future__ import annotations

import json
from collections.abc import Callable

#: No byte of UTF-8, so it can stand for the end of a word.
WORD_END = b"\xff"


def byte_of_char() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as characters: visible ones as they are, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def ranks(content: bytes) -> tuple[dict[bytes, int], bytes] | None:
    """Ids by bytes, and what ends a word; None if the ids are no ranks."""
    file = json.loads(content)
    model = file["model"]
    suffix = model.get("end_of_word_suffix") or ""
    if model.get("type") != "BPE" or any(model.get(x) for x in ("continuing_subword_prefix", "byte_fallback", "dropout", "ignore_merges")):
        return None
    added = {x["content"] for x in file["added_tokens"]}
    vocabulary = {token: i for token, i in model["vocab"].items() if token not in added}
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    singles = len(vocabulary) - len(merges)
    if singles != (512 if suffix else 256) or any(vocabulary.get(a + b) != singles + i for i, (a, b) in enumerate(merges)):
        return None
    byte = byte_of_char()
    made = {}
    for token, i in vocabulary.items():
        ends = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
        body = token[: -len(suffix)] if ends else token
        if not all(c in byte for c in body):
            return None
        made[bytes(map(byte.__getitem__, body)) + (WORD_END if ends else b"")] = i
    if any(made.get(bytes([b]), singles) >= 256 or (suffix and not 256 <= made.get(bytes([b]) + WORD_END, 0) < 512) for b in range(256)):
        return None
    return made, WORD_END if suffix else b""


def merger(content: bytes) -> tuple[Callable[[bytes], list[int]], bytes] | None:
    """A function from a prepared run (with its word end) to its ids, and the word end; None if the model has no ranks."""
    found = ranks(content)
    if found is None:
        return None
    from tiktoken import Encoding

    table, end = found
    return Encoding("runs", pat_str=r"\S+", mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece, end
