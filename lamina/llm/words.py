"""Words, word hashes and shingles of whole texts, in numpy, for use inside tasks.

A word is a run of bytes other than space and 0x09-0x0D, which never splits a UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Rows, and bytes of their texts, that a task works on at a time; one longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 1_000, 1 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, cut by the bytes of one column, so that arrays made of them stay small however long texts are."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))), at + SLICE_ROWS)
        yield batch.slice(at, end - at)
        at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_PLACE = keys(64, 23)
#: Masks that leave the first 0 to 8 bytes of a little-endian 64-bit load.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | (data - np.uint8(9) < 5)


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of ``data``, which ends with a space."""
    border = np.flatnonzero(is_space(data))
    before = np.concatenate([[-1], border[:-1]]) if len(border) else border
    real = border - before > 1
    return before[real] + 1, border[real]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word: its 8-byte parts, each mixed with the key of its place, summed and mixed again.

    Words longer than the rest only cost themselves more steps.
    """
    global _PLACE
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    n = ends - starts
    steps = -(-int(n.max()) // 8)
    if steps > len(_PLACE):
        _PLACE = keys(2 * steps, 23)
    out = n.astype(U64) * U64(0x9E3779B97F4A7C15)
    left, which, at = n, None, starts
    with np.errstate(over="ignore"):
        for j in range(steps):
            part = mixed((loads[at] & _FIRST[np.minimum(left, 8)]) + _PLACE[j])
            if which is None:
                out += part
                which = np.arange(len(starts))
            else:
                out[which] += part
            more = left > 8
            which, at, left = which[more], at[more] + 8, left[more] - 8
    return mixed(out)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array with a line feed after each, and the offsets of their first bytes and of the end."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return data, offsets


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of words before it (one entry more than texts)."""
    data, offsets = joined(texts)
    starts, ends = spans(data)
    return hashes(data, starts, ends), np.searchsorted(starts, offsets)


def windows(h: np.ndarray, n: int, seed: int = 37) -> np.ndarray:
    """Hash of every ``n`` consecutive words; none where there are fewer."""
    count = max(0, len(h) - n + 1)
    out = np.zeros(count, U64)
    with np.errstate(over="ignore"):
        for j, key in enumerate(keys(n, seed)):
            out += h[j : j + count] * key
    return mixed(out)


def shingles(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the ``n``-word shingles in order; of fewer words, the whole sequence as one; of none, nothing."""
    if len(h) >= n:
        return windows(h, n)
    return windows(np.append(h, U64(len(h))), len(h) + 1, 41) if len(h) else h
