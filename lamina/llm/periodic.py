"""Periodic runs of words: Lyndon arrays under both orders by grouping suffixes, then Lyndon roots extended into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.staging import col, doc_text
from lamina.llm.words import mixed, windows, word_hashes

U64 = np.uint64
#: A run has this many words at least (and two periods).
MIN_LENGTH = 12
#: Bytes of text whose words are looked at together inside a task; one longer text goes alone.
SLICE_BYTES = 4 << 20

# Prefix hashes: a prime whose products fit 64 bits, and two bases.
_PRIME = U64((1 << 31) - 1)
_BASES = (U64(1_103_515_245), U64(1_812_433_253 % ((1 << 31) - 1)))

RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, kept_text string"


def lyndon_lengths(letters: list[int], first: list[bool]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by the grouping phase of a suffix sorter.

    ``letters`` are numbers in their order; ``first`` marks places where another word sequence begins, so one call
    serves many.  Places are grouped by first letter.  From the highest group down, each place of a group
    is joined to the nearest place on its left whose group is still to come: that place's word grows by the
    group's word, once for each place joined, and it moves to a new group just above its old one, more
    joined places higher.  The word a place has in the end is its Lyndon word.
    """
    n = len(letters)
    values = sorted(set(letters))
    number = {v: g for g, v in enumerate(values)}
    group = [number[v] for v in letters]
    members: list[list[int]] = [[] for _ in values]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(values)
    below = list(range(-1, len(values) - 1))
    above = list(range(1, len(values) + 1))
    # Nearest place still to come, as place + 1; 0 where there is none.
    left = list(range(n + 1))
    current = len(values) - 1
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        members[current] = []
        for i in own:
            left[i + 1] = 0 if first[i] else i
        joined: dict[int, int] = {}
        for i in own:
            at = left[i + 1]
            while left[at] != at:
                left[at] = at = left[left[at]]
            left[i + 1] = at
            if at:
                joined[at - 1] = joined.get(at - 1, 0) + 1
        lifted: dict[tuple[int, int], list[int]] = {}
        for p, times in joined.items():
            lifted.setdefault((-times, group[p]), []).append(p)
        for key in sorted(lifted) if len(lifted) > 1 else lifted:
            times, g = key
            new, over = len(size), above[g]
            size.append(size[g] - times * size[current])
            members.append(lifted[key])
            below.append(g)
            above.append(over)
            above[g] = new
            below[over] = new
            for p in lifted[key]:
                group[p] = new
        current = below[current]
    return [size[g] for g in group]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), U64)
    filled, step = 1, base
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * step % _PRIME
        step = step * step % _PRIME
        filled += take
    return out


class Extensions:
    """Longest common extensions of pairs of places, by prefix hashes and halving."""

    def __init__(self, letters: np.ndarray):
        value = mixed(letters.astype(U64) + U64(0x9E3779B97F4A7C15)) % _PRIME
        self.power = [_powers(b, len(letters) + 1) for b in _BASES]
        self.prefix = [np.concatenate([[U64(0)], np.cumsum(value * p[:-1] % _PRIME)]) for p in self.power]

    def _equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        same = np.ones(len(i), bool)
        for power, prefix in zip(self.power, self.prefix, strict=True):
            same &= (prefix[i + n] - prefix[i]) % _PRIME * power[j - i] % _PRIME == (prefix[j + n] - prefix[j]) % _PRIME
        return same

    def right(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many letters agree from places i and j > i on, at most ``most``."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self._equal(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def left(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many letters agree before places i and j > i."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self._equal(i - mid, j - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def runs_of(letters: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Runs (start, length, period), sorted, of the sequences that begin at ``bounds``; the last bound is the end.

    Under the order in which the letter that ends a run is the smaller one, or the other, every run has a root that is the
    longest Lyndon word at its place.  So both Lyndon arrays hold all roots, and extending each
    shows whether two periods are there.  A root is no power, so its length is the smallest period.
    """
    n = len(letters)
    if not n:
        return np.zeros((0, 3), np.int64)
    which = np.searchsorted(bounds, np.arange(n), "right") - 1
    begin, end = bounds[which], bounds[which + 1]
    first = np.zeros(n, bool)
    first[bounds[:-1]] = True
    marks, extend, found = first.tolist(), Extensions(letters), []
    for ordered in (letters, letters.max() - letters):
        period = np.array(lyndon_lengths(ordered.tolist(), marks), np.int64)
        i = np.arange(n)
        j = i + period
        # A run goes on at least on one side of its root.
        goes = np.zeros(n, bool)
        inside = j < end
        goes[inside] = letters[i[inside]] == letters[j[inside]]
        behind = i > begin
        goes[behind] |= letters[i[behind] - 1] == letters[j[behind] - 1]
        goes &= end - begin >= np.maximum(2 * period, min_length)
        i, j, period = i[goes], j[goes], period[goes]
        before = extend.left(i, j, i - begin[i])
        after = extend.right(i, j, end[i] - j)
        length = before + period + after
        long = length >= np.maximum(2 * period, min_length)
        found.append(np.stack([(i - before)[long], length[long], period[long]], 1))
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def stretches(h: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of each text (words ``at[k]`` to ``at[k + 1]``) in which runs can lie.

    Half of a shortest run's words, in a row, come again within any run that holds them, and such windows
    cover the run whole.  So only what windows that repeat in their text cover is searched.
    """
    count = np.maximum(np.diff(at) - words + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    start = at[:-1][text] + np.arange(len(text)) - (np.cumsum(count) - count)[text]
    if not len(start):
        return start, start
    with np.errstate(over="ignore"):
        key = mixed(windows(h, words)[start] + mixed(text.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    text, start = text[again], start[again]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > start[:-1] + words) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(start)) - 1 if len(heads) else heads
    return start[heads], start[tails] + words


def runs_in_texts(texts: list[bytes], min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, length, period) of all texts, the text of each, and the number of words before each text.

    A word is compared by 64-bit hash.  Starts count from the first word of the text.
    """
    h, at = word_hashes(texts)
    begin, end = stretches(h, at, max(1, min_length // 2))
    if not len(begin):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), at
    size = end - begin
    bounds = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - begin, size)
    letters = np.unique(h[place], return_inverse=True)[1].astype(np.int64)
    found = runs_of(letters, bounds, min_length)
    start = place[found[:, 0]]
    text = np.searchsorted(at, start, "right") - 1
    found[:, 0] = start - at[text]
    return found, text, at


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        at = 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held + len(texts[stop]) <= SLICE_BYTES):
                held += len(texts[stop])
                stop += 1
            yield batch.column(0).slice(at, stop - at), texts[at:stop]
            at = stop


def _kept(text: bytes, runs: np.ndarray) -> str:
    words = text.split()
    if len(runs):
        gone = np.zeros(len(words), bool)
        for start, length, period in runs.tolist():
            gone[start + period : start + length] = True
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, runs, kept_text), one per row of ``docs``.

    ``runs`` are all maximal stretches of words with smallest period q that are ``max(min_length, 2 * q)`` words long at
    least, as (start, length, period) by start, then period.  ``kept_text`` is the text without the words that a
    run has after its first q, joined by one space.  Null, empty and blank texts have no runs and an empty
    ``kept_text``.  Rows stay apart whatever their ids, null or repeated; other columns are not read; an empty table
    gives no rows.  Every text is looked at alone, inside one task and in memory in proportion to it.
    """
    if min_length < 2:
        raise ValueError("a run has two words at least")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            found, text, _ = runs_in_texts(texts, min_length)
            ends = np.searchsorted(text, np.arange(len(texts) + 1))
            kept = [_kept(t, found[ends[k] : ends[k + 1]]) for k, t in enumerate(texts)]
            fields = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), fields)
            yield pa.RecordBatch.from_arrays([ids, runs, pa.array(kept, pa.string())], ["doc_id", "runs", "kept_text"])

    return doc_text(docs, id_col, text_col).mapInArrow(emit, RUNS)


def run_digests(runs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``periodic_runs``.

    The single figures are those of the longest run, of equally long ones the first, then of the least period.
    """
    longer = lambda a, b: (a["length"] > b["length"]) | ((a["length"] == b["length"]) & (F.struct(a["start"], a["period"]) < F.struct(b["start"], b["period"])))
    longest = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(longer(r, best), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return runs.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in which about a tenth of the documents, chosen by the checksum of their id, end periodically.

    With h the checksum, g = floor(h / 10) and n words: where 10 divides h, the words from number a = g % n on repeat the
    p = 1 + floor((n - a) / (3 + g % 8)) words that begin there.  Such texts are joined by one space.  Null ids are left alone.
    """
    rows = doc_text(docs, id_col, text_col)
    h = F.crc32(col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    g, n = F.col("g"), F.size("words")
    rows = rows.withColumn("n", F.when(n > 0, n)).withColumn("a", (g % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), _repeating("words", "a", "p", "n")).otherwise(F.col("text")).alias("text"))


def _repeating(words: str, a: str, p: str, n: str) -> Column:
    """The words before number ``a``, then the ``p`` words from there over and over, ``n`` in all."""
    w, at, period, rest = F.col(words), F.col(a), F.col(p), F.col(n) - F.col(a)
    block = F.slice(w, at + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / period).cast("int"))), F.lit(1), rest)
    return F.array_join(F.concat(F.slice(w, F.lit(1), at), tail), " ")
