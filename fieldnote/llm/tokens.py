"""Token ids of many texts with a public tokenizer file, each distinct piece of text encoded once.

Both kinds of tokenizer used here split a text before they merge. No split part crosses the start of a run of white
space, nor the place between an ASCII letter and ASCII punctuation other than the apostrophe. A text is cut into
pieces at those places (white space goes with the piece after it, or is left out for tokenizers that drop it), the
distinct pieces of a block of texts are encoded, and ids are gathered per text. Texts with white space other than
0x20 and 0x09-0x0D, which may join runs across a cut, and texts that may hold a special token are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fieldnote.llm.wordhash import BYTE_VALUES, P, Q, Texts, batches, distinct, long_hashes, mix, powers, runs, words

OTHER_SPACE = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPECIAL = "<|"
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = 2
CACHED = 2_000_000
"""Distinct pieces that a Python worker remembers (about 100 MB) before it starts again."""
TOGETHER = 2000
"""Pieces that are encoded as one string, with a separator whose id no piece without it can have."""


class Encoder:
    """Encodes blocks of texts. ``keep_space``: white space is part of the pieces, else it is dropped."""

    def __init__(self, path: str, keep_space: bool, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep_space, self.end = keep_space, end
        # a line feed is a token of its own before a letter or before a single blank; a bar between blanks is one
        self.sep = "\n" if keep_space else " | "
        self.apart = re.compile(r"[\n\t\r\x0b\x0c]|  | $" if keep_space else r"\|")
        (self.sep_id,) = self.tokenizer.encode(self.sep, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Append ids to the buffer; returns where they begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[at : self.used] = ids
        return at

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids begin in the buffer, and how many there are."""
        begin, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        alone = [i for i, x in enumerate(pieces) if self.apart.search(x)]
        for i, ids in zip(alone, self._texts([pieces[i] for i in alone]), strict=True):
            begin[i], size[i] = self._keep(ids), len(ids)
        lone = set(alone)
        rest = [i for i in range(len(pieces)) if i not in lone]
        for a in range(0, len(rest), TOGETHER):
            own = rest[a : a + TOGETHER]
            (ids,) = self._texts([self.sep + self.sep.join([pieces[i] for i in own])])
            at = np.flatnonzero(ids == self.sep_id) + 1
            begin[own] = self._keep(ids) + at
            size[own] = np.append(at[1:] - 1, len(ids)) - at
        return begin, size

    def _look_up(self, h: np.ndarray, piece: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the ids of each of some pieces with hashes ``h``; ``piece(i)`` is the i-th's text."""
        order = np.argsort(h)
        at, _ = runs(h[order])
        found = h[order][at]
        if len(self.known) > CACHED:
            self._forget()
        place = np.searchsorted(self.known, found)
        hit = place < len(self.known)
        hit[hit] = self.known[place[hit]] == found[hit]
        new = np.flatnonzero(~hit)
        if len(new):
            begin, size = self._encode_pieces([piece(i) for i in order[at[new]].tolist()])
            self.known = np.insert(self.known, place[new], found[new])
            self.begin, self.size = np.insert(self.begin, place[new], begin), np.insert(self.size, place[new], size)
            place = np.searchsorted(self.known, found)
        entry = np.empty(len(h), np.int64)
        entry[order] = np.repeat(place, np.diff(np.append(at, len(h))))
        return self.begin[entry], self.size[entry]

    def _pieces(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts (row numbers) of the pieces, in order."""
        w = words(t)
        kind = KIND[t.data]
        cuts = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1
        if self.keep_space:
            full = t.offsets[:-1][np.diff(t.offsets) > 0]
            starts = distinct(np.concatenate([full, w.ends, cuts]))
            starts = starts[starts < len(t.data)]
            ends = np.append(starts[1:], len(t.data))[: len(starts)]
        else:
            starts = distinct(np.concatenate([w.starts, cuts]))
            word = np.searchsorted(w.starts, starts, "right") - 1
            ends = np.minimum(np.append(starts[1:], len(t.data))[: len(starts)], w.ends[word])
        return starts, ends, np.searchsorted(t.offsets, starts, "right") - 1

    def encode(self, t: Texts, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, each text's followed by the end id; and the number of each text's."""
        starts, ends, row = self._pieces(t)
        cut = ~whole[row]
        starts, ends, row = starts[cut], ends[cut], row[cut]
        sums = np.zeros(len(t.data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[t.data] * powers(P, len(t.data)), out=sums[1:])
        down = powers(np.uint64(pow(int(P), -1, 2**64)), len(t.data) + 1)
        h = mix(((sums[ends] - sums[starts]) * down[starts]) ^ ((ends - starts).astype(np.uint64) * Q))
        h = long_hashes(h, t.data, starts, ends)
        raw = t.data.tobytes()
        begin, size = self._look_up(h, lambda i: raw[starts[i] : ends[i]].decode("utf-8"))
        rest = np.flatnonzero(whole)
        long = self._texts([raw[t.offsets[r] : t.offsets[r + 1]].decode("utf-8") for r in rest])
        # the texts encoded whole and the end id stand behind the remembered pieces for this block
        extra = np.concatenate([*long, np.array([self.end], np.uint32)])
        long_size = np.array([len(x) for x in long], np.int64)
        pool = np.concatenate([self.ids[: self.used], extra])
        begin = np.concatenate([begin, self.used + np.cumsum(long_size) - long_size, np.full(len(t), len(pool) - 1)])
        n = np.concatenate([size, long_size, np.ones(len(t), np.int64)])
        owner = np.concatenate([row, rest, np.arange(len(t))])
        order = np.argsort(owner, kind="stable")
        begin, n, owner = begin[order], n[order], owner[order]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pool[np.repeat(begin, n) + place], np.bincount(owner, weights=n, minlength=len(t)).astype(np.int64)


_ENCODERS: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, keep_space: bool, end: int) -> Encoder:
    """The encoder of this Python worker for a tokenizer file; what it remembers serves its next tasks too."""
    key = (path, keep_space, end)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, keep_space, end)
    return _ENCODERS[key]


def encoded(it: Iterator[pa.RecordBatch], coder: Encoder) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Per block of rows: the rows, all ids, and the number of ids of each row."""
    for b, t in batches(it, "text"):
        col = b.column(b.schema.get_field_index("text"))
        odd = pc.or_(pc.match_substring(col, SPECIAL), pc.match_substring_regex(col, OTHER_SPACE))
        whole = np.asarray(pc.fill_null(odd, False).to_numpy(zero_copy_only=False), bool)
        ids, n = coder.encode(t, whole)
        yield b, ids, n


def crc32s(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each run of ids as little-endian unsigned 32-bit numbers."""
    from zlib import crc32

    raw = memoryview(ids.astype("<u4").tobytes())
    ends = 4 * np.cumsum(n)
    return np.array([crc32(raw[e - 4 * k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)], np.int64)
