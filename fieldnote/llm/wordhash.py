"""Words of an Arrow column of texts, and 64-bit hashes of words and word windows, without a loop over words.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D. Those bytes never occur inside a longer UTF-8
character, so this is the word ``[^\\x20\\x09-\\x0D]+`` of the text. Hashes are polynomials modulo 2**64 over a
table of random byte values, taken from prefix sums, with a final mix; they are the same on every machine. Such
polynomials meet on some very regular strings of about a thousand bytes and more, so long stretches are hashed anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LONG_BYTES = 512
"""Stretches of more bytes get a hash of another kind."""
CHUNK_BYTES = 2_000_000
"""Texts are taken together up to this many bytes, so that scratch arrays stay small; a longer text is taken alone."""

P = np.uint64(0x9E3779B97F4A7C15)
Q = np.uint64(0xD1342543DE82EF95)
_ROOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _ROOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 2**64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i below ``n``; the longest run so far of each base is kept."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        p = np.full(max(1 << 16, n + n // 8), base, dtype=np.uint64)
        p[0] = 1
        _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Some rows of a text column: ``bytes[offsets[r]:offsets[r+1]]`` is row ``first + r``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, r: int) -> bytes:
        return self.data[self.offsets[r] : self.offsets[r + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow string column in chunks of at most ``limit`` bytes; null counts as empty."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(col) == 0:
        return
    col = pc.fill_null(col, "") if col.null_count else col
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(col))
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def long_hashes(h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``h`` with a hash of the bytes themselves for each long stretch ``data[starts[i]:ends[i]]``."""
    for i in np.flatnonzero(ends - starts > LONG_BYTES).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


@dataclass
class Words:
    """Words of some texts: byte ranges, and ``rows[r]:rows[r+1]`` the words of row r."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())


def words(t: Texts, inside_byte: np.ndarray | None = None) -> Words:
    """Longest runs of bytes within one text for which ``inside_byte`` is true; by default those of no white space."""
    n = len(t.data)
    inside = (~SPACE if inside_byte is None else inside_byte)[t.data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[t.offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, t.offsets))


def word_hashes(t: Texts, w: Words, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word; with ``lower`` of the word with A-Z lowered."""
    n = len(t.data)
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    values = (BYTE_VALUES[LOWER] if lower else BYTE_VALUES)[t.data]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(P, n), out=sums[1:])
    h = (sums[w.ends] - sums[w.starts]) * powers(_inverse(P), n)[w.starts]
    return long_hashes(mix(h ^ (w.ends - w.starts).astype(np.uint64) * Q), LOWER[t.data] if lower and (w.ends - w.starts).max() > LONG_BYTES else t.data, w.starts, w.ends)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes; element i starts at word i. Rows are not looked at."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(Q, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(_inverse(Q), n)[: n - k + 1])


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours of ``a``."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    return at, np.append(at[1:], len(a))


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct values of ``a``, sorted."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def batches(table_batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Each batch cut into chunks of its text column, with the rows of the chunk."""
    for b in table_batches:
        for t in chunks(b.column(b.schema.get_field_index(column)), limit):
            yield b.slice(t.first, len(t)), t
