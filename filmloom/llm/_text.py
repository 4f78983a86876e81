"""Words of whole Arrow text columns, found and hashed with numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; bounds memory to a few hundred bytes for each of them.
STEP = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def _lut(sep: np.ndarray) -> np.ndarray:
    """Lower-cased byte, 0 for a separator (byte 0 itself becomes 1 where it is a word byte: see ``SPACE``)."""
    out = _LOWER.copy()
    out[sep] = 0
    return out


#: Words `[^\x20\x09-\x0D]+`.  Byte 0 is a word byte here, so separators are kept in a mask of their own.
SPACE = (_LOWER, ~_SPACES)
_alnum = np.zeros(256, bool)
_alnum[48:58] = _alnum[65:91] = _alnum[97:123] = _alnum[128:] = True
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the lower-cased text.
ALNUM = (_LOWER, _alnum)

_rng = np.random.default_rng(20240607)
_RAND = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * STEP:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some consecutive rows: ``hash`` a word's 64-bit hash, ``doc`` its row, ``first`` each row's first word (and the end)."""

    rows: slice
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None = None

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    got = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return got, at - at[0]


def steps(at: np.ndarray, step: int = STEP) -> Iterator[slice]:
    """Row ranges of about ``step`` bytes; a longer row is a range of its own."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, "right")) - 1)
        yield slice(i, min(j, n))
        i = min(j, n)


def words(col: pa.Array, kind: tuple[np.ndarray, np.ndarray], hashed: bool = True, step: int = STEP) -> Iterator[Words]:
    """The words of every row of ``col``, some rows at a time."""
    data, at = raw(col)
    lower, isword = kind
    for r in steps(at, step):
        o = at[r.start : r.stop + 1] - at[r.start]
        d = lower[data[at[r.start] : at[r.stop]]]
        w = isword[d]
        n = len(d)
        if not n:
            z = np.zeros(0, np.int64)
            yield Words(r, d, z, z, z, np.zeros(r.stop - r.start + 1, np.int64), np.zeros(0, np.uint64))
            continue
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:] = False, w[:-1]
        after[-1], after[:-1] = False, w[1:]
        inner = o[(o > 0) & (o < n)]
        before[inner] = False
        after[inner - 1] = False
        start = np.flatnonzero(w & ~before)
        end = np.flatnonzero(w & ~after) + 1
        first = np.searchsorted(start, o)
        doc = np.repeat(np.arange(len(o) - 1), np.diff(first))
        h = None
        if hashed:
            c = np.zeros(n + 1, np.uint64)
            np.cumsum(_RAND[d] * _power(_P, n, "p"), out=c[1:])
            h = mix((c[end] - c[start]) * _power(_PINV, n, "q")[start] + (end - start).astype(np.uint64))
        yield Words(r, d, start, end, doc, first, h)


def hash_word(word: bytes) -> int:
    """The hash that ``words`` gives a lower-cased word."""
    a = np.frombuffer(word, np.uint8)
    c = (_RAND[a] * _power(_P, len(a), "p")).sum(dtype=np.uint64)
    return int(mix(np.array([c + np.uint64(len(a))], np.uint64))[0])


_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every n-word shingle: (row, hash, first word). A row of fewer words, but not none, is one shingle."""
    count = np.diff(w.first)
    total = len(w.doc)
    h = np.zeros(max(0, total - n + 1), np.uint64)
    for k in range(n):
        h += w.hash[k : total - n + 1 + k] * _MULT[k] if total >= n else 0
    keep = np.zeros(0, np.int64) if total < n else np.flatnonzero(w.doc[: total - n + 1] == w.doc[n - 1 :])
    doc, at = (w.doc[keep], keep) if total >= n else (np.zeros(0, np.int64),) * 2
    h = mix(h[keep]) if total >= n else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        s = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            s[has] += w.hash[w.first[short[has]] + k] * _MULT[k]
        s = mix(s + _MULT[n + 1] * count[short].astype(np.uint64))
        doc, h, at = np.concatenate([doc, short]), np.concatenate([h, s]), np.concatenate([at, w.first[short]])
    return doc, h, at
