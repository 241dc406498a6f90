"""Word shingles of whole texts, hashed in numpy over Arrow batches.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased.  A text's set holds its distinct shingles of
``width`` words; a text with fewer words has its whole word sequence as its one shingle; a text without words has
the empty set.  Shingles are 64-bit hashes, so two different shingles of one pair of texts are taken for equal with
a probability of about (number of shingles)^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text that one numpy pass takes at most, but for a single longer text.
CHUNK_BYTES = 2 << 20

_rng = np.random.default_rng(20240531)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MULTIPLIERS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
        if n <= CHUNK_BYTES + 1:
            _powers[name] = table
    return table[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, for each text where its words begin (one more entry than texts), and words' starts and ends.

    ``data`` holds the texts' bytes one after another and ``offsets`` where each begins, starting with 0.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data)
    letter = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, letter[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, letter[1:]
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power("down", _BASE_INVERSE, n)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * _MULTIPLIERS[63]), np.searchsorted(starts, offsets), starts, ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first, _, _ = word_hashes(data, offsets)
    counts = np.diff(first)
    total = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        total += words[k : k + len(total)] * _MULTIPLIERS[k]
    total = mix(total)
    sets = []
    for at, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
        if n >= width:
            sets.append(np.unique(total[at : at + n - width + 1]))
        elif n:
            own = (words[at : at + n] * _MULTIPLIERS[:n]).sum(dtype=np.uint64, keepdims=True)
            sets.append(mix(own + _MULTIPLIERS[n : n + 1]))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of at most ``limit`` bytes: first row, last row, bytes, offsets.  Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
