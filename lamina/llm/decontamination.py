"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.staging import col, doc_text
from lamina.llm.words import mixed, shingles, word_hashes

#: Fingerprint bits, in blocks of eight.
BITS = 128
BLOCKS = BITS // 8
#: Fingerprints this far apart or nearer are candidates.  Windows at similarity 0.75 are 22 bits apart on average,
#: with a deviation of about 4; unrelated ones 64.
RADIUS = 40
SHINGLE = 5
THRESHOLD = 0.75
#: Bytes of benchmark text that one pass over the documents carries, about.
BLOCK_BYTES = 8 << 20
_HIT_BITS = 20

FINDINGS = "doc_id long, item_id long, start long, n_words long, similarity double, distance int"


def signs(s: np.ndarray) -> np.ndarray:
    """For each shingle a row of +1 and -1, its contribution to every fingerprint bit."""
    both = np.stack([s, mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(s), BITS // 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(s: np.ndarray, length: int) -> np.ndarray:
    """SimHash (as ``BLOCKS`` bytes) of every ``length`` consecutive shingles, each weighted by its occurrences."""
    total = np.zeros((len(s) + 1, BITS), np.int32)
    np.cumsum(signs(s), axis=0, out=total[1:])
    return np.packbits(total[length:] - total[:-length] > 0, axis=1)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over united shingles, both counted with their occurrences."""
    values, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(index[: len(a)], minlength=len(values))
    y = np.bincount(index[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class BenchmarkIndex:
    """Items by shingle, and by every fingerprint block up to the error the radius leaves to the best block."""

    def __init__(self, items: list[tuple[int, str]]):
        h, at = word_hashes([(t or "").encode("utf-8").lower() for _, t in items])
        rows = [(item, int(at[i + 1] - at[i]), shingles(h[at[i] : at[i + 1]], SHINGLE)) for i, (item, _) in enumerate(items)]
        rows = [r for r in rows if len(r[2])]
        self.ids = [r[0] for r in rows]
        self.words = np.array([r[1] for r in rows], np.int64)
        self.shingles = [r[2] for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in self.shingles])
        every = np.concatenate(self.shingles) if rows else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.keys, self.owner = every[order], owner[order]
        self.maybe = np.zeros(1 << _HIT_BITS, bool)
        self.maybe[self.keys & np.uint64((1 << _HIT_BITS) - 1)] = True
        self.prints = np.stack([fingerprints(s, len(s))[0] for s in self.shingles]) if rows else np.zeros((0, BLOCKS), np.uint8)
        # Within the radius some block differs in at most radius // blocks bits: near[b, v] has a bit per such item.
        near = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS
        self.near = np.stack([np.packbits(near[:, self.prints[:, b]], axis=1) for b in range(BLOCKS)])

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row of ``prints``, item, distance) of every pair within the radius."""
        met = np.bitwise_or.reduce(self.near[np.arange(BLOCKS), prints], axis=1)
        rows, items = np.nonzero(np.unpackbits(met, axis=1, count=len(self.ids)))
        distance = _POPCOUNT[self.prints[items] ^ prints[rows]].sum(axis=1)
        for i in np.flatnonzero(distance <= RADIUS):
            yield int(rows[i]), int(items[i]), int(distance[i])

    def find(self, h: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(item, start, words, similarity, distance) of the best window per item that a text contains.

        A window is as long as the item, or the whole text where that is shorter.  Windows that share no
        shingle with an item of their size cannot reach the threshold and are not fingerprinted.
        """
        s = shingles(h, SHINGLE)
        hits = np.flatnonzero(self.maybe[s & np.uint64((1 << _HIT_BITS) - 1)])
        if not len(hits):
            return []
        low, high = np.searchsorted(self.keys, s[hits], "left"), np.searchsorted(self.keys, s[hits], "right")
        best: dict[int, tuple[float, int, int, int]] = {}
        wanted: dict[int, set[int]] = {}
        for p, a, b in zip(hits.tolist(), low.tolist(), high.tolist(), strict=True):
            for item in set(self.owner[a:b].tolist()):
                wanted.setdefault(min(len(self.shingles[item]), len(s)), set()).add(p)
        for size, places in wanted.items():
            near = np.array(sorted(places))
            # One run of starts per cluster of hits, so that a long text is fingerprinted only around them.
            cuts = np.flatnonzero(np.diff(near) > size) + 1
            for run in np.split(near, cuts):
                first, last = max(0, int(run[0]) - size + 1), min(len(s) - size, int(run[-1]))
                part = s[first : last + size]
                for row, item, distance in self.candidates(fingerprints(part, size)):
                    similarity = weighted_similarity(part[row : row + size], self.shingles[item])
                    if similarity >= THRESHOLD and (item not in best or (-similarity, first + row) < (-best[item][0], best[item][1])):
                        best[item] = (similarity, first + row, min(len(h), size + SHINGLE - 1), distance)
        return [(self.ids[i], start, words, sim, distance) for i, (sim, start, words, distance) in best.items()]


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[BenchmarkIndex]:
    """The benchmark in parts of about ``BLOCK_BYTES`` of text; each part is one pass over the documents."""
    items = benchmark.select(col(id_col).cast("long").alias("item_id"), col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // BLOCK_BYTES)
    for k in range(parts):
        yield BenchmarkIndex([(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()])


def _texts(column: pa.Array, step: int = 500) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, len(column), step):
        yield at, [(t or "").encode("utf-8").lower() for t in column.slice(at, step).to_pylist()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``FINDINGS``: each document and benchmark item it contains, with the best window.

    A window holds as many words as the item (or the whole text if shorter); words are lower-cased (A-Z)
    runs of non-space.  Similarity is that of five-word shingles weighted by their occurrences; 0.75 or more
    counts.  Ties go to the first window.  Null or wordless texts contain nothing, and null or wordless items
    are found nowhere.  A repeated row gives repeated findings; items that repeat an id give one finding
    per document, the best.  Documents are not shuffled but for that.
    """
    rows = doc_text(docs, id_col, text_col)
    out = None
    for index in benchmark_blocks(benchmark):

        def scan(batches: Iterator[pa.RecordBatch], index: BenchmarkIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), []
                for first, texts in _texts(batch.column(1)):
                    h, at = word_hashes(texts)
                    for i in range(len(texts)):
                        best: dict[int, tuple] = {}
                        for f in index.find(h[at[i] : at[i + 1]]):
                            best[f[0]] = max(best.get(f[0], f), f, key=lambda f: (f[3], -f[1]))
                        found += [(ids[first + i], *f) for f in best.values()]
                columns = zip(*found, strict=True) if found else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "n_words", "similarity", "distance"])

        part = rows.mapInArrow(scan, FINDINGS)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], FINDINGS) if out is None else out


def _clean(index: BenchmarkIndex):
    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        out = []
        for _, part in _texts(pa.array(texts, pa.string(), from_pandas=True)):
            h, at = word_hashes(part)
            out += [not index.find(h[at[i] : at[i + 1]]) for i in range(len(part))]
        return pd.Series(out, dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that contain a benchmark item; nothing is shuffled."""
    for index in benchmark_blocks(benchmark):
        docs = docs.where(_clean(index)(col(text_col)))
    return docs
