"""Word and shingle hashes of whole Arrow batches, without a Python loop over words.

Words are maximal runs of ASCII letters, digits, underscores and bytes beyond ASCII, with
A-Z lower-cased. A shingle is WORDS words in a row; a text of fewer words (but at least
one) is one shingle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes hashed at a time; bounds the memory, longer words and texts are put together from pieces.
CHUNK = 1 << 20

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


def _table(seed: int, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(f"{seed} {i}".encode(), digest_size=8).digest() for i in range(n)), _U)


_FOLD = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _FOLD[_c] = _c
for _c in range(26):
    _FOLD[65 + _c] = 97 + _c
_FOLD[128:] = np.arange(128, 256)
_BYTE = _table(1, 256).copy()
_BYTE[0] = 0
_PLACE = _table(2, WORDS) | _U(1)
_SHORT = _table(3, WORDS + 1)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _upto(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, m in enumerate((_MULT, _INV)):
            p = np.full(max(n, CHUNK + 1), m, _U)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=_U)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (splitmix64's finisher)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the offsets of its n rows (n + 1); null counts as empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)), offsets - offsets[0]


@dataclass
class Words:
    """hash and row of each word, in order; place: its first byte in the data."""

    hash: np.ndarray
    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    firsts = np.unique(offsets[:-1])
    firsts = firsts[firsts < n]
    parts, lo = [], 0
    while lo < n:
        hi = min(n, lo + CHUNK)
        x = _FOLD[data[lo:hi]]
        if hi < n:
            gap = np.flatnonzero(x == 0)
            while not len(gap) and hi < n:  # one very long word
                hi = min(n, hi + CHUNK)
                x = _FOLD[data[lo:hi]]
                gap = np.flatnonzero(x == 0)
            if hi < n:
                hi = lo + int(gap[-1]) + 1
                x = x[: hi - lo]
        at = firsts[np.searchsorted(firsts, lo) : np.searchsorted(firsts, hi)] - lo
        is_word = x != 0
        before = np.concatenate([[False], is_word[:-1]])
        before[at] = False
        after = np.concatenate([is_word[1:], [False]])
        after[at[at > 0] - 1] = False
        begin, end = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
        up, down = _upto(len(x) + 1)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[x] * up[: len(x)], dtype=_U)])
        parts.append((mix((total[end] - total[begin]) * down[begin] + _U(1)), begin + lo, end + lo))
        lo = hi
    if not parts:
        return Words(np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3)))
    h, begin, end = (np.concatenate(p) for p in zip(*parts))
    return Words(h, np.searchsorted(offsets, begin, "right") - 1, begin, end)


def shingles(w: Words, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle, repeats included, rows ascending; a row of several words begins at its first word."""
    h, row = w.hash, w.row
    full = np.zeros(0, _U)
    rows = np.zeros(0, np.int64)
    if len(h) >= WORDS:
        s = np.zeros(len(h) - WORDS + 1, _U)
        for j in range(WORDS):
            s += h[j : len(h) - WORDS + 1 + j] * _PLACE[j]
        same = row[: len(s)] == row[WORDS - 1 :]
        full, rows = mix(s[same]), row[: len(s)][same]
    count = np.bincount(row, minlength=n_rows)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        first = np.searchsorted(row, short)
        s = _SHORT[count[short]].copy()
        for j in range(WORDS - 1):
            there = count[short] > j
            s[there] += h[first[there] + j] * _PLACE[j]
        full, rows = np.concatenate([full, mix(s)]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        full, rows = full[order], rows[order]
    return full, rows


def bags(full: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their counts: hash, row, count; sorted by row, then hash."""
    order = np.lexsort((full, rows))
    full, rows = full[order], rows[order]
    if not len(full):
        return full, rows, np.zeros(0, np.int64)
    new = np.concatenate([[True], (full[1:] != full[:-1]) | (rows[1:] != rows[:-1])])
    at = np.flatnonzero(new)
    return full[at], rows[at], np.diff(np.append(at, len(full)))


def classes(w: Words, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128-bit digest of each row's sequence of words; of the raw text where there is no word."""
    n = len(offsets) - 1
    ends = np.searchsorted(w.row, np.arange(n), "right").tolist()
    h, out, i = w.hash, [], 0
    for k, j in enumerate(ends):
        if j > i:
            out.append(hashlib.blake2b(h[i:j].tobytes(), digest_size=16).digest())
        else:
            out.append(hashlib.blake2b(data[offsets[k] : offsets[k + 1]].tobytes(), digest_size=16, person=b"no words").digest())
        i = j
    return out


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 21):
    """Slices of a batch with about `size` bytes of text, or one longer text."""
    lengths = np.diff(raw(batch.column(column))[1])
    lo = held = 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > size:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < batch.num_rows:
        yield batch.slice(lo)
