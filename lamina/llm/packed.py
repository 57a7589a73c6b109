"""Fixed-width records that travel between tasks as byte strings, one string per bucket and batch.

Millions of small records would cost far more as rows.  Spark still deals the buckets out and shuffles them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PACKED = "bucket int, packed binary, done binary"
#: Bytes of records that one bucket should hold, about.
BUCKET_BYTES = 8 << 20


def buckets_for(total_bytes: int) -> int:
    """A power of two, 256 at least, that keeps buckets near ``BUCKET_BYTES`` at any size of the whole."""
    return 1 << max(8, (int(total_bytes) // BUCKET_BYTES).bit_length())


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The leading bits of 64-bit keys."""
    return (key >> np.uint64(65 - buckets.bit_length())).astype(np.int32)


def split(bucket: np.ndarray, records: np.ndarray) -> dict[int, bytes]:
    if not len(bucket):
        return {}
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    found, first = np.unique(bucket, return_index=True)
    ends = [*first[1:].tolist(), len(bucket)]
    return {b: records[x:y].tobytes() for b, x, y in zip(found.tolist(), first.tolist(), ends, strict=True)}


def batch_of(packed: dict[int, bytes], done: dict[int, bytes]) -> pa.RecordBatch:
    """One row per bucket.  ``done`` records only pass through to whatever comes next."""
    rows = sorted({*packed, *done})
    squeeze = lambda d: pa.array([pa.compress(d[b], "zstd", asbytes=True) if b in d else None for b in rows], pa.binary())
    sizes = [len(packed.get(b, b"")) for b in rows], [len(done.get(b, b"")) for b in rows]
    heads = [np.array(s, "<i8").tobytes() for s in zip(*sizes, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rows, pa.int32()),
            pa.array([h + (x or b"") for h, x in zip(heads, squeeze(packed).to_pylist(), strict=True)], pa.binary()),
            pa.array([x or b"" for x in squeeze(done).to_pylist()], pa.binary()),
        ],
        ["bucket", "packed", "done"],
    )


def records(table: pa.Table, kind: np.dtype, done_kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of one bucket, and all its records that are done."""
    packed, done = [], []
    for p, d in zip(table.column("packed").to_pylist(), table.column("done").to_pylist(), strict=True):
        n, m = np.frombuffer(p, "<i8", 2)
        if n:
            packed.append(pa.decompress(p[16:], int(n), "zstd", asbytes=True))
        if m:
            done.append(pa.decompress(d, int(m), "zstd", asbytes=True))
    return np.frombuffer(b"".join(packed), kind), np.frombuffer(b"".join(done), done_kind)


# ---- a filter of repeated 64-bit keys ----

FILTER_BITS = 1 << 28


def short_keys(keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Keys to be counted: 40 bits of each below the bucket's.

    Two of each are enough to tell that a key repeats, so a key of very many rows sends two from each batch.
    """
    keys, count = np.unique(keys, return_counts=True)
    keys = np.concatenate([keys, keys[count > 1]])
    lead = np.uint64(buckets.bit_length() - 1)
    low = ((keys << lead) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return batch_of(split(bucket_of(keys, buckets), np.ascontiguousarray(low)), {})


def repeated_bits(buckets: int):
    """For ``applyInArrow``: the filter bits of one bucket's keys that occur more than once, as (bucket, at, bits).

    The filter is a bitmap over the leading bits of a key; each bucket owns a stretch of it.
    """
    lead = buckets.bit_length() - 1
    own = (FILTER_BITS.bit_length() - 1) - lead

    def found(table: pa.Table) -> pa.Table:
        low, _ = records(table, np.dtype("u1"), np.dtype("u1"))
        keys = np.zeros((len(low) // 5, 8), np.uint8)
        keys[:, :5] = low.reshape(-1, 5)
        keys = np.sort(keys.view("<u8").ravel())
        again = np.unique(keys[1:][keys[1:] == keys[:-1]])
        bits = np.zeros(max(8, 1 << own), bool)
        bits[(again >> np.uint64(40 - own)).astype(np.int64)] = True
        return pa.table({"bucket": pa.array(table.column("bucket").to_pylist()[:1], pa.int32()), "bits": pa.array([pa.compress(np.packbits(bits), "zstd", asbytes=True)], pa.binary())})

    return found, 1 << own


class KeyFilter:
    """A bitmap of ``FILTER_BITS`` bits, whatever the corpus: the repeated keys and few others.

    Where a corpus has so many repeated keys that it fills up, more candidates pass; the exact
    comparison that follows decides.
    """

    def __init__(self, rows: Iterator, buckets: int):
        span = FILTER_BITS // buckets
        self.bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for r in rows:
            part = np.frombuffer(pa.decompress(r["bits"], max(8, span) // 8, "zstd", asbytes=True), np.uint8)
            self.bits[r["bucket"] * span // 8 : r["bucket"] * span // 8 + span // 8] = part[: span // 8]

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.uint64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(65 - FILTER_BITS.bit_length())).astype(np.int64)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def runs(position: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of [position, position + length), sorted."""
    order = np.argsort(position, kind="stable")
    start = position[order]
    end = np.maximum.accumulate(start + (length if np.isscalar(length) else length[order]))
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return start[first], end[last]
