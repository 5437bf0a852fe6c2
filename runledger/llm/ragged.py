"""Words and their hashes of a whole Arrow batch at once, as flat numpy arrays.

A word is a run of bytes other than ASCII white space. Its hash is a difference of running
sums of byte values times powers of an odd base, brought to one origin and mixed; it depends
on the word's bytes only. Memory beyond the words' own arrays is bounded by ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from runledger.llm.common import Memo

PIECE = 1 << 20
PORTION = 4 << 20
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def numbers(count: int, start: int) -> np.ndarray:
    """Fixed numbers that look random."""
    return mixed((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(start)) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x2545F4914F6CDD1D
_VALUES = numbers(256, 1000)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_POWERS: dict[str, np.ndarray] = Memo("powers")


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            powers = np.full(PIECE + 1, base, np.uint64)
            powers[0] = 1
            _POWERS[name] = np.multiply.accumulate(powers)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in ascending order and do not overlap."""
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        if ends[upto - 1] - low > PIECE:  # one span above a piece: hash it by pieces
            total = np.uint64(0)
            for k, begin in enumerate(range(int(low), int(ends[at]), PIECE)):
                part = data[begin : min(begin + PIECE, int(ends[at]))]
                total += np.sum(_VALUES[part] * up[: len(part)], dtype=np.uint64) * np.uint64(pow(_BASE, k * PIECE, 1 << 64))
            out[at], upto = total, at + 1
        else:
            part = data[low : ends[upto - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_VALUES[part] * up[: len(part)], out=sums[1:])
            first, last = starts[at:upto] - low, ends[at:upto] - low
            out[at:upto] = (sums[last] - sums[first]) * down[first]
        at = upto
    return mixed(out + (ends - starts).astype(np.uint64))


class Texts:
    """The texts of a column: their bytes one after another, and where each begins."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each run of flagged bytes; runs end where a text ends."""
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < len(inside)]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~_SPACE[self.data])


def bounds(owner: np.ndarray, count: int) -> np.ndarray:
    """Where each text's items begin in a list sorted by text number, and the end."""
    return np.searchsorted(owner, np.arange(count + 1))


def windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of ``size`` words in one text."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, owner.dtype)
    total = np.zeros(count, np.uint64)
    for k, factor in enumerate(numbers(size, 77)):
        total += hashes[k : k + count] * (factor | np.uint64(1))
    same = owner[:count] == owner[size - 1 :]
    return mixed(total[same]), owner[:count][same]


def portions(batch: pa.RecordBatch, column: str, most: int = PORTION, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text and ``rows`` rows at most each, one row at least."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        upto = min(at + rows, max(at + 1, int(np.searchsorted(sizes, done + most, "right"))))
        yield batch.slice(at, upto - at)
        at = upto
