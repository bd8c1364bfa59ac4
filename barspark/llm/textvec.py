"""Vectorised word hashing over Arrow text batches (numpy inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PIECE = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of words; ``ranges`` are the separators, both ends included."""
    t = np.ones(256, dtype=bool)
    for a, b in ranges:
        t[a : b + 1] = False
    return t


#: Letters, digits and everything beyond ASCII make words (texts are lower-cased before).
LETTERS = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Everything but ASCII white space makes words.
SPACED = byte_table((0x20, 0x20), (0x09, 0x0D))

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None:
        inv = pow(_R, -1, 1 << 64)
        up, down = np.full(_PIECE + 1, _R, dtype=np.uint64), np.full(_PIECE + 1, inv, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def words(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word in ``data``; equal bytes have equal hashes.

    The hash is a polynomial over the word's bytes, taken from prefix sums, one piece of a megabyte at a time,
    so that memory stays bounded for very long texts; a word longer than a piece is hashed in one go.
    """
    buf = np.frombuffer(data, dtype=np.uint8)
    inside = table[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    up, down = _power_tables()
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + _PIECE, side="right"))
        if j <= i:
            word = buf[base : ends[i]].astype(np.uint64) + np.uint64(1)
            whole = np.uint64(0)
            for at in range(0, len(word), _PIECE):
                part = word[at : at + _PIECE]
                whole = whole * up[1] + (part * up[: len(part)]).sum(dtype=np.uint64) + np.uint64(at)
            out[i] = whole
            i += 1
            continue
        prefix = np.zeros(ends[j - 1] - base + 1, dtype=np.uint64)
        np.cumsum((buf[base : ends[j - 1]].astype(np.uint64) + np.uint64(1)) * up[: len(prefix) - 1], out=prefix[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (prefix[e] - prefix[s]) * down[s]
        i = j
    with np.errstate(over="ignore"):
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(_R)), starts, ends


def text_slices(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) in slices of about ``limit`` bytes; null is empty. A longer text is alone.

    Only one slice is out of Arrow at a time, and what is computed on it is a small multiple of its size.
    """
    data = texts.cast(pa.large_binary())
    size = np.asarray(pc.fill_null(pc.binary_length(data), 0), dtype=np.int64)
    ends = np.cumsum(size)
    first = 0
    while first < len(size):
        before = ends[first] - size[first]
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, [t or b"" for t in data.slice(first, last - first).to_pylist()]
        first = last


def hashed_words(parts: list[bytes], table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all parts one after the other, offsets: part i has hashes[offsets[i]:offsets[i + 1]])."""
    data = b"\n".join(parts)
    if lower:
        data = data.translate(LOWER)
    h, starts, _ = words(data, table)
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)))
    return h, np.concatenate([[0], np.searchsorted(starts, ends)])
