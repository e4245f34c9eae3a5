"""Token ids of whole texts, each distinct pre-token encoded once.

A byte-level BPE splits a text by a fixed pattern and encodes the pieces one by one, so the ids of a text are those
of its pieces on end. Texts of Latin letters are split here by array operations on their bytes and each distinct
piece is encoded by ``tokenizers`` once a worker (the memory is emptied when it holds ``KEPT`` pieces); any other
text (letters beyond U+024F, contractions, rare white space or control characters, a special token's string) goes
to ``tokenizers`` whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from . import blocks as B

KEPT = 1 << 20
_LETTER, _DIGIT, _SPACE, _OTHER, _HARD = 1, 2, 3, 4, 9
_LIMIT, _LAST = 0x250, 0x280  # characters of these lead bytes reach to U+027F; from _LIMIT on they are hard
#: Texts that the array split leaves to the library: contractions and special tokens.
_ODD = re.compile(rb"'(?:[stmd]|re|ve|ll)|<\|")


def _classes() -> tuple[np.ndarray, np.ndarray]:
    import regex

    one = np.full(_LAST, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"), (_SPACE, r"\s")):
        for c in range(_LIMIT):
            if regex.match(pattern, chr(c)):
                one[c] = kind
    one[[c for c in range(32) if c not in (9, 10, 11, 12, 13)]] = _HARD
    one[[0x85, 0xA0]] = _HARD
    one[_LIMIT:] = _HARD
    first = np.full(256, _HARD, np.uint8)
    first[:128] = one[:128]
    first[0x80:0xCA] = 0  # later bytes, and leads of two up to U+027F, come from the character
    return first, one


class Encoder:
    """Encodes blocks of texts; made once a worker process."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.first, self.one = _classes()
        self._empty()

    def _empty(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)  # of each known piece in the flat ids
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        ids = self._whole(texts)
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        known = np.concatenate([self.known, hashes])
        place = np.concatenate([self.place, len(self.flat) + np.cumsum(counts) - counts])
        count = np.concatenate([self.count, counts])
        order = np.argsort(known, kind="stable")
        self.known, self.place, self.count, self.flat = known[order], place[order], count[order], np.concatenate([self.flat, flat])

    def encode(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows on end, and how many each has."""
        data, edges = block.data, block.offsets
        kinds = self.first[data]
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xCA))
        if len(lead):
            points = (data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F
            kinds[lead] = kinds[lead + 1] = self.one[points]
        hard = np.zeros(block.rows, bool)
        where = np.flatnonzero((kinds == _HARD) | (kinds == 0))
        hard[np.searchsorted(edges, where, side="right") - 1] = True
        whole = data.tobytes()
        for m in _ODD.finditer(whole):
            hard[np.searchsorted(edges, m.start(), side="right") - 1] = True
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[edges] = True
        starts = begins[:-1].copy()
        starts[1:] |= kinds[1:] != kinds[:-1]
        joined = np.zeros(n, bool)  # a run that takes the space before it
        joined[1:] = (data[:-1] == 32) & (kinds[1:] != _SPACE)
        starts &= ~(joined & ~begins[:-1])
        last = (kinds == _SPACE) & ~begins[1:]  # the last white space before something else
        last[:-1] &= kinds[1:] != _SPACE
        starts |= last
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], n)
        sums, down = B.prefix(data.astype(np.uint64) + np.uint64(1))
        hashes = B.mix((sums[ends] - sums[at]) * down[at] + (ends - at).astype(np.uint64))
        row = np.searchsorted(edges, at, side="right") - 1
        if hard.any():
            keep = ~hard[row]
            at, ends, hashes, row = at[keep], ends[keep], hashes[keep], row[keep]
        unique, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > KEPT:
            self._empty()
        found = np.searchsorted(self.known, unique)
        new = np.flatnonzero((found == len(self.known)) | (self.known[np.minimum(found, len(self.known) - 1)] != unique) if len(self.known) else np.ones(len(unique), bool))
        if len(new):
            self._learn(unique[new], [whole[a:b] for a, b in zip(at[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
            found = np.searchsorted(self.known, unique)
        counts, places = self.count[found][back], self.place[found][back]
        per_row = np.bincount(row, counts, block.rows).astype(np.int64)
        ids = self.flat[np.repeat(places, counts) + B.ragged(counts)]
        if not hard.any():
            return ids, per_row
        rest = np.flatnonzero(hard)
        split = np.split(ids, np.cumsum(per_row)[:-1])
        for i, x in zip(rest.tolist(), self._whole([whole[edges[i] : edges[i + 1]] for i in rest]), strict=True):
            split[i], per_row[i] = x, len(x)
        return np.concatenate(split), per_row


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(path: str, column) -> Iterator[tuple[B.Block, np.ndarray, np.ndarray]]:
    for block in B.blocks(column):
        yield block, *encoder(path).encode(block)
