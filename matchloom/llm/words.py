"""Words and word shingles of Arrow text columns as 64-bit hashes, in numpy.

A byte string's hash is a polynomial over random byte values, taken for all
words at once from prefix sums, then mixed. Texts are cut into pieces at word
ends, so working memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
SPACES = b" \t\n\v\f\r"

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LANES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: ASCII letters and every byte of a non-ASCII character.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << (n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _STEP, np.uint64), np.full(size, _BACK, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    up, down = _powers[size]
    return up, down


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins and the last ends.
    Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, size = 0, len(data)
    while lo < size:
        hi = min(size, lo + PIECE)
        if hi < size:
            cut = offsets[np.searchsorted(offsets, hi, "right") - 1]  # a text's end
            if cut <= lo:
                while True:  # the last gap before hi, or the first after it
                    gaps = np.flatnonzero(gap[data[lo:hi]])
                    if len(gaps) or hi == size:
                        break
                    hi = min(size, hi + PIECE)
                cut = lo + int(gaps[-1]) + 1 if len(gaps) and hi < size else hi
            hi = int(cut)
        yield lo, hi
        lo = hi


def word_hashes(texts: pa.Array, gap: np.ndarray = IS_SPACE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin and end
    (texts + 1 bounds). A word is a run of bytes outside ``gap``."""
    data, offsets = raw(texts)
    hashes, begins = [], []
    for lo, hi in _pieces(data, offsets, gap):
        part = data[lo:hi]
        word = ~gap[part]
        edge = np.zeros(len(part) + 1, bool)  # a text begins here
        inside = offsets[(offsets >= lo) & (offsets <= hi)] - lo
        edge[inside] = True
        starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
        ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
        up, down = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[fold[part]] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts]))
        begins.append(starts + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def sequence_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        out += hashes[j : j + len(out)] * _LANES[j]
    return mix(out + np.uint64(n))


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingles of each text; a text of fewer words
    has its whole sequence as one, a text without words none."""
    hashes, bounds = word_hashes(texts)
    all_runs = sequence_hash(hashes, n)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= n:
            yield np.unique(all_runs[lo : hi - n + 1])
        elif hi > lo:
            yield sequence_hash(hashes[lo:hi], int(hi - lo))
        else:
            yield hashes[:0]


def slices(batch: pa.RecordBatch, column: int, most: int = 2 * PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most about ``most`` bytes of text, a row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = raw(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
