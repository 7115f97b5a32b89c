"""Array primitives over the UTF-8 bytes of many texts at once; they run inside Spark tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: ASCII white space that separates words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and a-z: what separates words once A-Z is lower-cased.
NO_WORD = np.zeros(256, dtype=bool)
NO_WORD[:0x80] = True
NO_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multiplier of the rolling word hash and one random word for each byte value.
_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes end to end, and the n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def groups_of(offsets: np.ndarray, most: int):
    """(first, last + 1) runs of whole texts of about ``most`` bytes; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words; a word never crosses the end of its text."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(separator[data], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):  # where a word runs on from one text into the next
        joined = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])
        if len(joined):
            starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, dtype=np.uint64)
        down = np.full(n, pow(_BASE, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche over 64-bit words."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes hashed at a time, which bounds the tables of powers.
_BLOCK = 1 << 18


def _block_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial over some bytes, and the powers that move a sum back to position 0."""
    up, down = _powers(1 << max(19, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_RANDOM[data] * up[: len(data)], out=sums[1:], dtype=np.uint64)
    return sums, down


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word (ascending, apart from each other): a polynomial by prefix sums,
    then mixed with the length."""
    out, first = np.empty(len(starts), dtype=np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _BLOCK, "right")))
        a, s, e = int(starts[first]), starts[first:last], ends[first:last]
        sums, down = _block_sums(data[a : int(e[-1])])
        h = (sums[e - a] - sums[s - a]) * down[s - a]
        out[first:last] = mixed(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = last
    return out


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position."""
    n = max(0, len(data) - size + 1)
    out = np.empty(n, dtype=np.uint64)
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        sums, down = _block_sums(data[a : b + size - 1])
        out[a:b] = mixed((sums[size:] - sums[:-size]) * down[: b - a])
    return out


def text_groups(column: pa.Array | pa.ChunkedArray, most: int = 2 << 20):
    """(first, last + 1, bytes, offsets) of runs of whole texts of about ``most`` bytes; null is empty."""
    data, offsets = flat(column)
    for first, last in groups_of(offsets, most):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
