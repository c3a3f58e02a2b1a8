"""Vectorised word hashing over Arrow string buffers.

Words are maximal runs of letters, digits and marks, after a case fold that keeps byte lengths
(ASCII and Latin-1 letters), so offsets also hold for the original text. Punctuation, symbols and
spaces of any script end a word; each character of a script that is written without spaces (Han,
kana, Thai, Lao, Khmer, Burmese) is a word of its own. Everything runs on whole buffers with
numpy: no Python object is made per word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 2 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

#: Blocks of scripts without spaces between words.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 ends words, 1 is part of one, 2 is a word of its own."""
    out = np.ones(0x110000, dtype=np.uint8)
    for c in range(0x80, 0x1FB00):  # beyond are letters, and private or unassigned code points
        if unicodedata.category(chr(c))[0] in "PSZC" and not 0xD800 <= c < 0xF900:
            out[c] = 0
    for a, z in _UNSPACED:
        out[a : z + 1][out[a : z + 1] == 1] = 2
    return out


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept per worker and grown when needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of h."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes, byte for byte."""
    out = data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)
    if len(data) > 1:
        nxt = data[1:]
        up = (data[:-1] == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)
        out[1:] += up.view(np.uint8) * np.uint8(32)
    return out


@dataclass
class Words:
    """Words of rows first .. last - 1 of a batch, in order."""

    first: int
    last: int
    row: np.ndarray  #: row of the batch, one per word
    start: np.ndarray  #: byte offsets within ``data``
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray  #: folded bytes of all rows
    offsets: np.ndarray  #: where each row begins in ``data``, and the end of the last

    def row_bounds(self) -> np.ndarray:
        """Index of the first word of each row, and the number of words."""
        return np.searchsorted(self.row, np.arange(self.first, self.last + 1))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; null texts have no bytes."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return offsets, data


def words(texts: pa.Array | pa.ChunkedArray, chunk: int = CHUNK_BYTES) -> Iterator[Words]:
    """Hashed words of a string array, in runs of whole rows of about ``chunk`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    offsets, data = buffers(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1)
        last = min(last, len(texts))
        lo, hi = int(offsets[first]), int(offsets[last])
        yield _words(fold(data[lo:hi]), offsets[first : last + 1] - lo, first, last)
        first = last


def _words(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> Words:
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    edge = np.zeros(n + 1, dtype=bool)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        _wide(data, lead, inside[1:], edge)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, n), out=total[1:])
    h = (total[end] - total[start]) * powers(_INVERSE, n + 1)[start]
    row = np.searchsorted(offsets, start, "right") - 1 + first
    return Words(first, last, row, start, end, mix(h ^ ((end - start).astype(U64) << U64(48))), data, offsets)


def _wide(data: np.ndarray, lead: np.ndarray, inside: np.ndarray, edge: np.ndarray) -> None:
    """Takes separators of more than a byte, which begin at ``lead``, out of words, and sets words of one character apart."""
    first = data[lead]
    size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
    code = (first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))).astype(np.int64)
    for k in (1, 2, 3):
        more = size > k
        byte = data[np.minimum(lead + k, len(data) - 1)] & 0x3F
        code = np.where(more, (code << 6) | byte, code)
    kind = _kinds()[np.minimum(code, 0x10FFFF)]
    for k in range(4):
        inside[lead[(kind == 0) & (size > k)] + k] = False
    alone = kind == 2
    edge[lead[alone]] = True
    edge[lead[alone] + size[alone]] = True


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; runs at the end that are too short are absent."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=U64)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(h * powers(_BASE, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_INVERSE, n + 1)[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in time that doesn't depend on w."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
