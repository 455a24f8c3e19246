"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once with numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, after lower-casing A-Z; UTF-8 makes that the same as for
characters. A shingle is five consecutive words; a text of one to four words has its whole sequence as its one shingle; a
text without words has none. Shingles are told apart by 64-bit hashes: two texts compared share a false shingle with
a probability of about (shingles of the one) x (of the other) / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240501)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 2**63, WIDTH + 1, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, _STEP)]), dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts data[bounds[i]:bounds[i + 1]]: the words' hashes, their starts in data, and each text's first word."""
    part = ~_SPACE[data]
    first = part.copy()
    first[1:] &= ~part[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    first[inner] = part[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(bounds), np.int64)
    number = np.cumsum(first) - 1
    number[number < 0] = 0
    place = np.arange(len(data)) - starts[number]
    place[~part] = 0
    value = _BYTE[data] * powers(int(place.max()) + 1)[place]
    value[~part] = 0
    return mix(np.add.reduceat(value, starts)), starts, np.searchsorted(starts, bounds)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole texts in runs of about CHUNK bytes: (number of the first, bytes, bounds). A null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingle_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles."""
    for _, data, bounds in chunks(texts):
        h, _, first = words(data, bounds)
        if len(h) >= WIDTH:
            wide = h[: len(h) - WIDTH + 1] * _PLACE[0]
            for k in range(1, WIDTH):
                wide = wide + h[k : len(h) - WIDTH + 1 + k] * _PLACE[k]
            wide = mix(wide)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= WIDTH:
                yield np.unique(wide[a : b - WIDTH + 1])
            elif b > a:
                whole = (h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
                yield mix(whole + _PLACE[WIDTH : WIDTH + 1] * np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
