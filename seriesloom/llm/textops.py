"""Vectorised word scanning over Arrow string buffers.

Texts arrive as Arrow UTF-8 arrays.  ``scan`` finds every word of every text and
a 64-bit polynomial hash of it with a handful of NumPy passes over fixed-size
byte segments, so that neither the number of words nor the length of one text
decides how much memory is used at once beyond about 16 bytes a word.

Hashes are arithmetic modulo 2**64 with an odd base over a random value per
byte, finished with a bit mixer.  Equal words have equal hashes; unequal words
collide with a chance of about 2**-64 per pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV_BASE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over 64 output bits (a bijection)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_PW = _powers(_BASE, SEGMENT + 1)
_IPW = _powers(_INV_BASE, SEGMENT + 1)
_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(member) -> np.ndarray:
    return np.array([bool(member(b)) for b in range(256)])


#: Bytes of words that white space (space, 0x09 to 0x0D) separates.
SPACED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of words of ASCII digits and letters and everything beyond ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Bytes of lines.
LINES = _table(lambda b: b != 0x0A)
#: Bytes that begin a code point.
CODE_POINTS = _table(lambda b: b & 0xC0 != 0x80)


@dataclass
class Spans:
    """Maximal runs of member bytes; ``at[i]:at[i + 1]`` are those of text i."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def docs(self) -> np.ndarray:
        """The text of each span."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts())


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        kind = np.int32
    else:
        kind = np.int64
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = texts.buffers()
    off = np.frombuffer(raw[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def scan(data: np.ndarray, off: np.ndarray, member: np.ndarray = SPACED, lower: bool = True) -> Spans:
    """All maximal runs of ``member`` bytes within each text.

    ``lower`` folds ASCII capitals in the hash (not in the positions).  Texts
    without members have no spans.
    """
    values = _VALUES[_LOWER] if lower else _VALUES
    n = len(data)
    opens = np.zeros(n + 1, bool)
    opens[off] = True
    starts, ends, p_start, p_end, i_start = [], [], [], [], []
    base = 0
    for a in range(0, n, SEGMENT):
        b = min(n, a + SEGMENT)
        seg = data[a:b]
        m = member[seg]
        before = np.empty_like(m)
        before[1:] = m[:-1]
        before[0] = a > 0 and member[data[a - 1]]
        after = np.empty_like(m)
        after[:-1] = m[1:]
        after[-1] = b < n and member[data[b]]
        st = np.flatnonzero(m & (~before | opens[a:b]))
        en = np.flatnonzero(m & (~after | opens[a + 1 : b + 1])) + 1
        sums = np.empty(b - a + 1, _U)
        sums[0] = 0
        np.cumsum(values[seg] * _PW[: b - a], out=sums[1:])
        scale = _U(pow(_BASE, a, 1 << 64))
        sums = sums * scale + _U(base)
        starts.append(st + a)
        ends.append(en + a)
        p_start.append(sums[st])
        p_end.append(sums[en])
        i_start.append(_IPW[st] * _U(pow(_INV_BASE, a, 1 << 64)))
        base = int(sums[-1])
    if not starts:
        none = np.zeros(0, np.int64)
        return Spans(np.zeros(0, _U), none, none, np.zeros(len(off), np.int64))
    start, end = np.concatenate(starts), np.concatenate(ends)
    h = mix((np.concatenate(p_end) - np.concatenate(p_start)) * np.concatenate(i_start))
    return Spans(h, start, end, np.searchsorted(start, off))


def windows(words: Spans, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every run of k words within a text, in order."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.ones(n - k + 1, bool)
    for d in range(1, k):
        # a window that starts d words before a text's end (k > d) is cut
        cut = words.at[1:] - d
        cut = cut[(cut >= words.at[:-1]) & (cut < len(inside))]
        inside[cut] = False
    first = np.flatnonzero(inside)
    h = words.hash[first]
    for d in range(1, k):
        h = h * _U(0xC2B2AE3D27D4EB4F) + words.hash[first + d]
    docs = np.searchsorted(words.at, first, side="right") - 1
    return mix(h), docs, first


def count_bytes(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Member bytes of each text."""
    out = np.zeros(len(off) - 1, np.int64)
    if not len(data) or not len(out):
        return out
    for a in range(0, len(data), SEGMENT * 4):
        b = min(len(data), a + SEGMENT * 4)
        sums = np.zeros(b - a + 1, np.int64)
        np.cumsum(member[data[a:b]], out=sums[1:])
        lo, hi = np.searchsorted(off, a, side="right") - 1, np.searchsorted(off, b, side="left")
        cuts = np.clip(off[lo : hi + 1], a, b) - a
        out[lo:hi] += sums[cuts[1:]] - sums[cuts[:-1]]
    return out


def pieces(texts: pa.Array, most: int = 4 << 20):
    """Slices (first row, array) of about ``most`` bytes, whole texts each."""
    _, off = buffers(texts)
    row, n = 0, len(off) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + most, side="right")) - 1)
        yield row, texts.slice(row, stop - row)
        row = stop
