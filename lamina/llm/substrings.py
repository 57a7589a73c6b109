"""Substring deduplication by difference-cover anchors."""

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
from lamina.llm.words import mixed, windows, word_hashes

WINDOW = 20
#: Any two positions, shifted by some same number below PERIOD, both fall on the cover: {0, 1, 3, 9} has every
#: difference modulo 13.  So two equal windows share an anchor of WINDOW - PERIOD + 1 words that both hash.
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
BATCH = 1_000

ENTRY = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("crc", "<u4"), ("start", "<i4")])
PLACE = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("start", "<i4")])
RANGES = "doc long, crc long, key long, ranges binary"


def _windows(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word windows that lie in one text, their texts and their first words."""
    h, at = word_hashes(texts)
    count = np.maximum(np.diff(at) - n + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    start = np.arange(len(doc)) - first[doc]
    every = windows(h, n)
    return every[at[:-1][doc] + start] if len(doc) else np.zeros(0, np.uint64), doc, start


def _encoded(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part, [t.encode("utf-8", "surrogatepass") for t in part.column(column).to_pylist()]


def anchors(rows: DataFrame, buckets: int) -> KeyFilter:
    """The anchors that occur more than once, as a filter."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _encoded(batches, 0):
            h, _, start = _windows(texts, ANCHOR)
            yield short_keys(h[np.isin(start % PERIOD, COVER)], buckets)

    found, _ = repeated_bits(buckets)
    bits = rows.select("text").mapInArrow(emit, PACKED).groupBy("bucket").applyInArrow(found, "bucket int, bits binary")
    return KeyFilter(bits.toLocalIterator(), buckets)


def _later(entry: np.ndarray) -> np.ndarray:
    """Which of the entries have their hash in common with an earlier place (smaller doc, then start)."""
    order = np.lexsort((entry["start"], entry["crc"], entry["doc"], entry["hash"]))
    e = entry[order]
    new = np.concatenate([[True], e["hash"][1:] != e["hash"][:-1]]) if len(e) else np.zeros(0, bool)
    head = e[np.flatnonzero(new)][np.cumsum(new) - 1] if len(e) else e
    later = np.zeros(len(entry), bool)
    later[order] = (e["doc"] != head["doc"]) | (e["crc"] != head["crc"]) | (e["start"] != head["start"])
    return later


def _by_doc(place: np.ndarray, buckets: int) -> dict[int, bytes]:
    return split(bucket_of(mixed(place["doc"].astype(np.uint64) ^ (place["crc"].astype(np.uint64) << np.uint64(32))), buckets), place)


def _places(entry: np.ndarray) -> np.ndarray:
    out = np.empty(len(entry), PLACE)
    for f in PLACE.names:
        out[f] = entry[f]
    return out


def later_windows(rows: DataFrame, repeated: KeyFilter, buckets: int) -> DataFrame:
    """Stored rows of ``RANGES``: per document the words covered by windows that also start earlier.

    Only windows that hold a repeated anchor are extended to their full length and compared.  Windows that
    come again within one batch are settled there, so that a passage of very many documents
    sends few records.
    """
    sent = rows.sparkSession.sparkContext.broadcast(repeated)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _encoded(batches, 2):
            small, doc, start = _windows(texts, ANCHOR)
            hit = np.isin(start % PERIOD, COVER)
            hit[hit] = sent.value.holds(small[hit])
            # A window at s holds the anchors at s to s + PERIOD - 1.
            total = np.concatenate([[0], np.cumsum(hit)])
            h, owner, first = _windows(texts, WINDOW)
            count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
            base = (np.cumsum(count) - count)[owner] + first
            take = total[np.minimum(base + PERIOD, len(hit))] > total[base]
            entry = np.empty(int(take.sum()), ENTRY)
            owner = owner[take]
            entry["hash"], entry["start"] = h[take], first[take]
            entry["doc"] = np.array(part.column(0).to_pylist(), np.int64)[owner]
            entry["crc"] = np.array(part.column(1).to_pylist(), np.int64)[owner].astype(np.uint32)
            later = _later(entry)
            yield batch_of(split(bucket_of(entry["hash"][~later], buckets), entry[~later]), _by_doc(_places(entry[later]), buckets))

    def compare(table: pa.Table) -> pa.Table:
        entry, done = records(table, ENTRY, PLACE)
        packed = _by_doc(np.concatenate([done, _places(entry[_later(entry)])]), buckets)
        return pa.Table.from_batches([batch_of(packed, {})])

    def cover(table: pa.Table) -> pa.Table:
        place, _ = records(table, PLACE, PLACE)
        place = np.unique(place)
        new = np.concatenate([[True], (place["doc"][1:] != place["doc"][:-1]) | (place["crc"][1:] != place["crc"][:-1])]) if len(place) else np.zeros(0, bool)
        out = []
        for p in np.split(place, np.flatnonzero(new)[1:]) if len(place) else []:
            starts, ends = runs(p["start"].astype(np.int64), WINDOW)
            out.append((int(p["doc"][0]), int(p["crc"][0]), np.stack([starts, ends]).astype("<i8").tobytes()))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"doc": pa.array(columns[0], pa.int64()), "crc": pa.array(columns[1], pa.int64()), "ranges": pa.array(columns[2], pa.binary())})

    met = rows.select("doc", "crc", "text").mapInArrow(emit, PACKED).groupBy("bucket").applyInArrow(compare, PACKED)
    found = met.groupBy("bucket").applyInArrow(cover, "doc long, crc long, ranges binary")
    return stage(found.select("doc", "crc", row_key("doc", "crc").alias("key"), "ranges"), "later-words")


def _removed(ranges: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(ranges, "<i8").reshape(2, -1)) if ranges else (np.zeros(0, np.int64),) * 2


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, kept_text), one per row of ``docs``.

    Words are runs of non-space, unchanged.  A word goes if some 20 consecutive words that cover it also start
    earlier: in a smaller doc_id, or earlier in the same document.  ``kept_text`` is what stays, joined by one
    space.  Null text has no words; texts under 20 words lose none.  Null doc_ids come after all others.
    Rows that repeat both id and text are one document and get equal rows; of different texts under
    one id, the one with the smaller checksum counts as earlier.  An empty table gives none.

    Of documents with equal words only the first is compared with others: the later ones are covered whole.
    """
    rows = identified(doc_text(docs, id_col, text_col))
    words = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    later = copies(rows, words).where("not first")
    single = without(rows, later)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets_for(size // 2)
    found = later_windows(single, anchors(single, buckets), buckets)
    whole = later.select("doc", "crc", "key", F.lit(b"").alias("ranges"))
    marked = beside(rows, found.unionByName(whole))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                n = len(words)
                if ranges == b"":
                    kept = [] if n >= WINDOW else words
                else:
                    starts, ends = _removed(ranges)
                    kept = words if not len(starts) else [w for a, b in zip([0, *ends.tolist()], [*starts.tolist(), n], strict=True) for w in words[a:b]]
                joined = b" ".join(kept)
                out.append((doc_id, n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)], names)

    return marked.select("doc_id", "text", "ranges").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
