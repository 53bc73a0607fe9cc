"""Vectorised hashing of words and word n-grams over the bytes of many texts at once.

A word is a run of bytes other than space and \\t..\\r, with A-Z lowered; bytes of UTF-8 sequences are never white
space, so this is the same as splitting code points. A word's hash is a polynomial over random 64-bit
values of its bytes, an n-gram's a polynomial over its words' hashes; both are finished by splitmix64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_P_INV = _U(pow(int(_P), -1, 1 << 64))
_Q = _U(0xD6E8FEB86659FD93)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at once; a longer text is taken by itself.
CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mix(z: np.ndarray) -> np.ndarray:
    """splitmix64."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or held.size < n:
        held = np.full(max(n, CHUNK + 1), base, _U)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if n <= CHUNK + 1:
            _powers[int(base)] = held
    return held[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray):
    """Ranges of rows with about CHUNK bytes each."""
    row, rows = 0, offsets.size - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word and first word of each text (one more than texts); starts and ends of the words in raw."""
    solid = ~_BLANK[raw]
    first, last = solid.copy(), solid.copy()
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < raw.size)]
    if raw.size:
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(raw.size + 1, _U)
    np.cumsum(_BYTES[raw] * _power(_P, raw.size), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power(_P_INV, raw.size + 1)[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(starts, offsets), starts, ends


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n-gram that starts at a word, whatever the texts' ends; n - 1 fewer than words."""
    if hashes.size < n:
        return np.zeros(0, _U)
    out = np.zeros(hashes.size - n + 1, _U)
    for k in range(n):
        out = out * _Q + hashes[k : k + out.size]
    return mix(out + _U(n))
