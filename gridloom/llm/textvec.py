"""Whole-text primitives over Arrow string arrays, vectorised in numpy: no Python object per word.

Texts are handled as their UTF-8 bytes. A null text counts as empty. A text is never cut: a slice
holds whole rows, one row at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ``[\x20\x09-\x0D]``
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII letters and every byte of a non-ASCII character.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        _power = np.concatenate([np.ones(1, np.uint64), np.full(max(n, 64) - 1, _STEP)]).cumprod(dtype=np.uint64)
    return _power


def text_array(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return pc.fill_null(col, "")


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after the other, and the offsets of the rows in them."""
    col = text_array(col)
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1] if at is not None and len(col) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``most`` bytes of text each, so that work arrays stay small."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes.astype(np.int64)) // most
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows]):
        yield batch.slice(a, b - a)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes within a row: 64-bit hash of the lower-cased bytes, start, length, row."""
    if len(data) > 4 << 20 and len(offsets) > 2:  # in parts of whole rows, so that work arrays stay small
        cut = min(max(1, int(np.searchsorted(offsets, len(data) // 2))), len(offsets) - 2)
        at = int(offsets[cut])
        a, b = words(data[:at], offsets[: cut + 1], is_word), words(data[at:], offsets[cut:] - at, is_word)
        return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1] + at]), np.concatenate([a[2], b[2]]), np.concatenate([a[3], b[3] + cut])
    inside = is_word[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    begins = inside & ~before
    starts = np.flatnonzero(begins)
    at = np.flatnonzero(inside)
    heads = np.flatnonzero(begins[at])
    lengths = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, lengths)
    hashed = _BYTE[LOWER[data[at]]] * powers(int(lengths.max()))[place]
    h = mix(np.add.reduceat(hashed, heads) ^ lengths.astype(np.uint64))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return h, starts, lengths, rows


def shingles(h: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and their rows, in order; a row of fewer words is one shingle, one of none has none."""
    if not len(h):
        return h, rows
    count = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((count > 0) & (count < size))
    out_h, out_r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= size:
        whole = rows[: len(h) - size + 1] == rows[size - 1 :]
        s = np.zeros(len(whole), np.uint64)
        for j in range(size):
            s = s * _STEP + h[j : len(h) - size + 1 + j]
        out_h, out_r = mix(s[whole]), rows[: len(whole)][whole]
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        extra = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = count[short] > j
            extra[has] = extra[has] * _STEP + h[begin[short[has]] + j]
        out_h, out_r = np.append(out_h, mix(extra)), np.append(out_r, short)
        order = np.argsort(out_r, kind="stable")
        out_h, out_r = out_h[order], out_r[order]
    return out_h, out_r
