"""Repeated byte strings by prefix-free parsing: phrases, their suffixes and what follows them, in corpus order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.packed import PACKED, KeyFilter, batch_of, bucket_of, buckets_for, records, repeated_bits, runs, short_keys, split
from lamina.llm.staging import doc_text, stage
from lamina.llm.unique_texts import beside, copies, identified, row_key, without
from lamina.llm.words import keys, mixed

LENGTH = 400
#: A phrase ends at the least rolling hash of so many consecutive positions, so none is longer.
SPAN = 64
#: Bytes after a phrase border that every string assigned to it holds.
CORE = LENGTH - (SPAN - 1)
SIDE = SPAN - 1
#: Bytes of text parsed at a time, unless one text is longer.
CHUNK = 1 << 20

U64 = np.uint64
ENTRY = np.dtype([("core", "<u8"), ("doc", "<i8"), ("crc", "<u4"), ("at", "<i4"), ("low", "u1"), ("high", "u1"), ("known", "u1"), ("left", "u1", SIDE), ("right", "u1", SIDE)])
FOUND = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("at", "<i4"), ("bits", "<u8")])

_BYTE = keys(256, 53)
_LEFT, _RIGHT = keys(SIDE, 61), keys(SIDE, 67)
_ROLL = keys(1, 71)[0]
_STEP = keys(1, 73)[0]
_BACK = U64(pow(int(_STEP), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * CHUNK), base, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


class Parse:
    """The phrases of some texts, as far as strings of ``LENGTH`` bytes start in them.

    The border of a string is the first position of the least rolling hash among its first ``SPAN`` positions: it
    depends on the string alone, so equal strings have their border at the same place.  What stands before
    it is a suffix of a phrase (at most ``SIDE`` bytes); what follows is the parse from there on.  ``border`` has a
    row per phrase border, ``low`` and ``high`` say how far before it its strings may start.
    """

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(b"".join([*texts, bytes(LENGTH)]), np.uint8)
        n = int(self.offsets[-1])
        count = np.maximum(self.sizes - LENGTH + 1, 0)
        if not count.any():
            self.border = self.doc = self.low = self.high = np.zeros(0, np.int64)
            return
        loads = np.ndarray(n + SPAN, "<u8", self.data, 0, (1,))
        with np.errstate(over="ignore"):
            least = (loads * _ROLL) & U64(0xFFFFFFFF00000000)
        least |= np.arange(len(least), dtype=U64)
        step = 1
        while step < SPAN:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        doc = np.repeat(np.arange(len(texts)), count)
        start = np.arange(len(doc)) + (self.offsets[:-1] - (np.cumsum(count) - count))[doc]
        place = (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.append(new[1:], len(place)) - 1
        self.border, self.doc = place[new], doc[new]
        self.low, self.high = self.border - start[last], self.border - start[new]

    def cores(self) -> np.ndarray:
        """Hash of the ``CORE`` bytes from each border on."""
        if not len(self.border):
            return np.zeros(0, U64)
        n = int(self.offsets[-1])
        total = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[self.data[:n]] * _power("up", _STEP, n), out=total[1:])
            return mixed((total[self.border + CORE] - total[self.border]) * _power("down", _BACK, n + 1)[self.border])


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(column).to_pylist()]
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or i == len(texts) - 1:
                yield batch.slice(first, i + 1 - first), texts[first : i + 1]
                first, size = i + 1, 0


def contexts(rows: DataFrame, buckets: int) -> KeyFilter:
    """The cores that follow more than one border, as a filter."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _chunks(batches, 0):
            yield short_keys(Parse(texts).cores(), buckets)

    found, _ = repeated_bits(buckets)
    bits = rows.select("text").mapInArrow(emit, PACKED).groupBy("bucket").applyInArrow(found, "bucket int, bits binary")
    return KeyFilter(bits.toLocalIterator(), buckets)


def _entries(part: pa.RecordBatch, texts: list[bytes], repeated: KeyFilter) -> np.ndarray:
    parse = Parse(texts)
    core = parse.cores()
    take = np.flatnonzero(repeated.holds(core))
    out = np.zeros(len(take), ENTRY)
    if not len(take):
        return out
    border, doc = parse.border[take], parse.doc[take]
    out["core"], out["low"], out["high"] = core[take], parse.low[take], parse.high[take]
    out["doc"] = np.array(part.column(0).to_pylist(), np.int64)[doc]
    out["crc"] = np.array(part.column(1).to_pylist(), np.int64)[doc].astype(np.uint32)
    out["at"] = border - parse.offsets[doc]
    side = np.arange(SIDE)
    left = parse.data[np.maximum(border[:, None] - SIDE + side, 0)]
    right = parse.data[border[:, None] + CORE + side]
    # Bytes that none of the entry's strings reaches are blank, so that equal entries are equal records.
    left[side[None, :] < SIDE - out["high"][:, None].astype(int)] = 0
    right[side[None, :] >= SIDE - out["low"][:, None].astype(int)] = 0
    out["left"], out["right"] = left, right
    return out


def _all_bits(entry: np.ndarray) -> np.ndarray:
    width = (entry["high"] - entry["low"] + 1).astype(U64)
    return np.where(width >= 64, ~U64(0), (U64(1) << np.minimum(width, U64(63))) - U64(1)) << entry["low"].astype(U64)


def _found(entry: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.empty(len(entry), FOUND)
    for f in ("doc", "crc", "at"):
        out[f] = entry[f]
    out["bits"] = bits
    return out


def _merged(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries with equal strings within one batch: one of them, marked, to meet others; what is found for the rest."""
    if not len(entry):
        return entry, _found(entry, np.zeros(0, U64))
    with np.errstate(over="ignore"):
        name = mixed(
            entry["core"] ^ (_BYTE[entry["left"]] * _LEFT).sum(axis=1, dtype=U64) + (_BYTE[entry["right"]] * _RIGHT).sum(axis=1, dtype=U64) * U64(3) + entry["low"] + U64(256) * entry["high"]
        )
    _, first, inverse, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    head = np.zeros(len(entry), bool)
    head[first] = True
    # A row that the table holds twice is no repetition: it has the same document and place.
    same = entry[first][inverse]
    other = (same["doc"] != entry["doc"]) | (same["crc"] != entry["crc"]) | (same["at"] != entry["at"])
    several = np.bincount(inverse, other, minlength=len(first)) > 0
    kept = entry[first].copy()
    kept["known"] = several
    rest = entry[~head & several[inverse]]
    return kept, _found(rest, _all_bits(rest))


def _one_of_each(entry: np.ndarray) -> np.ndarray:
    """Entries of repeated rows once; one that has met another document's string in its batch goes before those that have not."""
    place = ["core", "doc", "crc", "at"]
    entry = entry[np.unique(entry[[*place, "known"]], return_index=True)[1]]
    last = np.ones(len(entry), bool)
    last[:-1] = entry[place][1:] != entry[place][:-1]
    return entry[last]


def _matched(entry: np.ndarray) -> np.ndarray:
    """For each entry the starts (bits: bytes before the border) whose string occurs in another entry too.

    Sorted by what follows the border, then by the phrase suffix before it, equal strings are neighbours.
    """
    bits = np.where(entry["known"] > 0, _all_bits(entry), U64(0)) if len(entry) else np.zeros(0, U64)
    order = np.argsort(entry["core"], kind="stable")
    core = entry["core"][order]
    again = np.zeros(len(core), bool)
    again[1:] = core[1:] == core[:-1]
    again[:-1] |= again[1:].copy()
    which = order[again]
    e = entry[which]
    if not len(e):
        return bits
    with np.errstate(over="ignore"):
        left = np.zeros((len(e), SPAN), U64)
        np.cumsum((_BYTE[e["left"]] * _LEFT)[:, ::-1], axis=1, out=left[:, 1:])
        right = np.zeros((len(e), SPAN), U64)
        np.cumsum(_BYTE[e["right"]] * _RIGHT, axis=1, out=right[:, 1:])
        before = np.arange(SPAN, dtype=U64)
        name = mixed(e["core"][:, None] ^ mixed(left + before * U64(0x9E3779B97F4A7C15)) + right[:, ::-1])
    valid = (before >= e["low"][:, None]) & (before <= e["high"][:, None])
    row, x = np.nonzero(valid)
    name = name[valid]
    order = np.argsort(name)
    name = name[order]
    equal = name[1:] == name[:-1]
    hit = np.zeros(len(name), bool)
    hit[1:] = equal
    hit[:-1] |= equal
    row, x = row[order[hit]], x[order[hit]].astype(U64)
    own = np.zeros(len(e), U64)
    np.bitwise_or.at(own, row, U64(1) << x)
    bits[which] |= own
    return bits


def _by_doc(found: np.ndarray, buckets: int) -> dict[int, bytes]:
    return split(bucket_of(mixed(found["doc"].astype(U64) ^ (found["crc"].astype(U64) << U64(32))), buckets), found)


def repeated_strings(rows: DataFrame, repeated: KeyFilter, buckets: int) -> DataFrame:
    """Stored (doc, crc, key, ranges): per document the bytes covered by strings that also start elsewhere."""
    sent = rows.sparkSession.sparkContext.broadcast(repeated)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _chunks(batches, 2):
            entry, done = _merged(_entries(part, texts, sent.value))
            yield batch_of(split(bucket_of(entry["core"], buckets), entry), _by_doc(done, buckets))

    def compare(table: pa.Table) -> pa.Table:
        entry, done = records(table, ENTRY, FOUND)
        entry = _one_of_each(entry)
        bits = _matched(entry)
        hit = bits != 0
        return pa.Table.from_batches([batch_of(_by_doc(np.concatenate([done, _found(entry[hit], bits[hit])]), buckets), {})])

    def cover(table: pa.Table) -> pa.Table:
        found, _ = records(table, FOUND, FOUND)
        found = found[np.lexsort((found["at"], found["crc"], found["doc"]))]
        new = np.concatenate([[True], (found["doc"][1:] != found["doc"][:-1]) | (found["crc"][1:] != found["crc"][:-1])]) if len(found) else np.zeros(0, bool)
        out = []
        for f in np.split(found, np.flatnonzero(new)[1:]) if len(found) else []:
            row, x = np.nonzero(f["bits"][:, None] >> np.arange(SPAN, dtype=U64) & U64(1))
            starts, ends = runs(f["at"].astype(np.int64)[row] - x, LENGTH)
            out.append((int(f["doc"][0]), int(f["crc"][0]), np.stack([starts, ends]).astype("<i8").tobytes()))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"doc": pa.array(columns[0], pa.int64()), "crc": pa.array(columns[1], pa.int64()), "ranges": pa.array(columns[2], pa.binary())})

    met = rows.select("doc", "crc", "text").mapInArrow(emit, PACKED).groupBy("bucket").applyInArrow(compare, PACKED)
    ranges = met.groupBy("bucket").applyInArrow(cover, "doc long, crc long, ranges binary")
    return stage(ranges.select("doc", "crc", row_key("doc", "crc").alias("key"), "ranges"), "repeated-bytes")


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one per row of ``docs``.

    The text counts as UTF-8 bytes, null as none.  A byte goes if some 400 bytes that cover it also start at
    another place, in this or another document.  ``n_spans`` counts the maximal runs that go; ``kept`` is
    what stays (binary, as a cut may divide a character).  Rows that repeat both id and text are one document:
    they get equal rows and are no repetition of each other; different texts under one id, and texts under null
    ids, are documents of their own.  An empty table gives none.

    Of documents with equal texts one is compared with others; all of them go whole, if long enough.
    """
    rows = identified(doc_text(docs, id_col, text_col))
    same = copies(rows, F.col("text"))
    single = without(rows, same.where("not first"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets_for(size)
    found = repeated_strings(single, contexts(single, buckets), buckets)
    whole = same.select("doc", "crc", "key", F.lit(b"").alias("ranges"))
    partly = found.join(same.select("doc", "crc"), ["doc", "crc"], "left_anti").select("doc", "crc", "key", "ranges")
    marked = beside(rows, partly.unionByName(whole))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text.encode("utf-8", "surrogatepass")
                n, spans, kept = len(text), 0, text
                if ranges == b"":
                    spans, kept = (1, b"") if n >= LENGTH else (0, text)
                elif ranges:
                    starts, ends = np.frombuffer(ranges, "<i8").reshape(2, -1).tolist()
                    spans, kept = len(starts), b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, n], strict=True))
                out.append((doc_id, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return marked.select("doc_id", "text", "ranges").mapInArrow(cut, schema)
