"""Words of texts as 64-bit hashes, and sketches and part signatures of word sets, for whole Arrow batches.

A batch is one run of hashes (``words``) and the sizes of its sets; every step is one pass over the run, never a
loop over words. What the signatures promise stands in ``operators/dedupe.py``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SMALL_SET = 24
"""Below this many words, signatures cover three parts at once; from it on, one part of ~5 words."""

LONG_WORD = 128
"""A word of more bytes is hashed on its own: the sums that other words are hashed by meet on very long regular strings."""

CHUNK_BYTES = 2_000_000
"""Texts are taken together up to this many bytes; a longer text is taken alone."""

_STEP = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(LONG_WORD, 0xD1342543DE82EF93, dtype=np.uint64)]))
_LOWER = np.zeros(256, dtype=np.uint8)
"""The lower-case form of a byte of a word ``[a-z0-9']+``; 0 for other bytes."""
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789'":
    _LOWER[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _LOWER[_c] = _c + 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of some texts, as ``functions.text.words`` finds them, as hashes in order, and their number in each text.

    All texts come, in order, in chunks; null has no words.
    """
    # the two letters outside ASCII whose lower case has an ASCII letter
    for letter, lower in (("\u0130", "i\u0307"), ("\u212a", "k")):
        column = pc.replace_substring(column, letter, lower)
    column = pc.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        ends = offsets[at : to + 1] - offsets[at]
        yield _hashed(_LOWER[data[offsets[at] : offsets[to]]], ends)
        at = to


def _hashed(low: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = low != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(low)]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    n = np.diff(np.searchsorted(starts, ends))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), n
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    size = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, size)
    words = mix(np.add.reduceat(_VALUES[low[at]] * _POWERS[np.minimum(place, LONG_WORD)], first) + mix(size.astype(np.uint64)))
    for i in np.flatnonzero(size > LONG_WORD):
        words[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : starts[i] + size[i]].tobytes(), digest_size=8).digest())
    return words, n


def sketches(words: np.ndarray, sizes: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` numbers a set: for each hash value of ``64 * lanes`` whether an odd number of its words has it."""
    bits, out = 64 * lanes, np.empty((len(sizes), lanes), dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    value = (mix(words) % np.uint64(bits)).astype(np.int64)
    for at in range(0, len(sizes), 2048):
        k = min(2048, len(sizes) - at)
        own = np.repeat(np.arange(k) * bits, sizes[at : at + k])
        odd = np.bincount(own + value[ends[at] : ends[at + k]], minlength=k * bits).astype(np.uint8) & 1
        out[at : at + k] = np.packbits(odd, bitorder="little").view(np.int64).reshape(k, lanes)
    return out


def _parts(window: np.ndarray, t: float) -> np.ndarray:
    """Parts for sets whose sizes fall in the size bands ``window`` and ``window + 1``."""
    return np.ceil((1 - t) / (1 + t) * 2 * np.power(1 / t, window + 2.0) + 1e-6).astype(np.int64)


def _dealt(words: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part of each set a hash of its words and their number; and where the parts of each set begin."""
    start = np.cumsum(parts) - parts
    scrambled = mix(words)
    at = np.repeat(start, sizes) + (scrambled % np.repeat(parts.astype(np.uint64), sizes)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    count = np.bincount(at, minlength=int(parts.sum()))
    # words of a part are added up, so their order does not matter
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(scrambled ^ _STEP)[order], dtype=np.uint64)])
    ends = np.cumsum(count)
    return total[ends] - total[ends - count], count, start


def signatures(words: np.ndarray, sizes: np.ndarray, t: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of all sets and, of each, the place of its set."""
    words = words ^ mix(np.array([seed + 1], dtype=np.uint64))
    ends = np.cumsum(sizes)
    out, whose = [], []
    with np.errstate(divide="ignore"):
        band = np.floor(np.log(sizes.astype(float)) / math.log(1 / t) + 1e-9)
    small, large = (sizes < math.ceil(SMALL_SET / t)) & (sizes > 0), sizes >= SMALL_SET
    for back in (0, 1):
        for some, short in ((small, True), (large, False)):
            rows = np.flatnonzero(some)
            if not len(rows):
                continue
            n, window = sizes[rows], (band[rows] - back).astype(np.int64)
            held = words[np.repeat(ends[rows] - n - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            needed = _parts(window, t)
            key = mix(window.astype(np.uint64) * np.uint64(2) + np.uint64(short) + _STEP)
            if short:
                parts = needed + 2
                content, _, start = _dealt(held, n, parts)
                for p in np.unique(parts):
                    of = np.flatnonzero(parts == p)
                    own = mix(content[start[of][:, None] + np.arange(p)] + mix(np.arange(p, dtype=np.uint64) + _STEP))
                    three = np.array(list(combinations(range(p), 3)))
                    sig = mix(own[:, three[:, 0]] + mix(own[:, three[:, 1]] + mix(own[:, three[:, 2]] + key[of][:, None])))
                    out.append(sig.ravel())
                    whose.append(np.repeat(rows[of], len(three)))
            else:
                # ``spare`` parts may be too thin to use: a set with more thin parts than that uses them too
                spare = np.ceil(needed * 0.15).astype(np.int64) + 2
                parts = needed + spare
                content, count, start = _dealt(held, n, parts)
                own = np.repeat(np.arange(len(rows)), parts)
                full = count > 1
                thin = parts - np.bincount(own[full], minlength=len(rows))
                used = full | (thin > spare)[own]
                place = (np.arange(len(own)) - start[own])[used].astype(np.uint64)
                out.append(mix(content[used] + mix(place + key[own[used]])))
                whose.append(rows[own[used]])
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out).view(np.int64), np.concatenate(whose)
