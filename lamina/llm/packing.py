"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion."""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.staging import doc_text, stage

CAPACITY = 2048
#: Rows of one length that are numbered in one task, about.
ROWS_PER_SALT = 100_000
#: Choices that branch and bound looks at, at most, before the best packing so far stands.
NODES = 10_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: How the byte-level vocabularies split text before they merge bytes. Fixed value.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond these letters the libraries' tables of letters and digits may be of different age.
_BEYOND = re.compile("[^\x00-\u024f]")


def _byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones as they are, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def rank_encoding(path: str):
    """The tokenizer file as a table of merge ranks for ``tiktoken``, which gives the same ids several times as fast.

    None unless the file is plain byte-level BPE whose ids follow the order of its merges.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    vocabulary, letters = model["vocab"], _byte_of_letter()
    made = [vocabulary.get(m.replace(" ", "") if isinstance(m, str) else "".join(m), -1) for m in model["merges"]]
    added = {t["content"] for t in spec.get("added_tokens", ())}
    tokens = {t: i for t, i in vocabulary.items() if t not in added}
    if made != sorted(set(made)) or made[:1] < [0] or any(c not in letters for t in tokens for c in t):
        return None
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in tokens.items()}, special_tokens={})


class TextTokenizer:
    """Token ids of whole texts, as little-endian 32-bit bytes, by the tokenizer file at ``path``.

    Texts of Latin letters without added tokens are merged by rank; all others go to the tokenizer.  Both give the
    same ids.  Nothing is remembered from text to text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = rank_encoding(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None

    def _ranked(self, text: str) -> bool:
        return (text.isascii() or not _BEYOND.search(text)) and not (self.added and self.added.search(text))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if self.ranks is not None and self._ranked(text):
                yield np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()
            else:
                yield np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.cache
def text_tokenizer(path: str) -> TextTokenizer:
    """One per Python worker, of a fixed size."""
    return TextTokenizer(path)


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than ``capacity``."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity
    starts = ([0] if first else []) + list(range(first, total, capacity))
    return [(s, (first if first and s == 0 else capacity)) for s in starts]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Rows of ``PIECES``: every document's ids and ``end_id``, cut where longer than ``capacity``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = text_tokenizer(tokenizer), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    ids += last
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.mapInArrow(pieces, PIECES)


# ---- bin completion over a histogram of lengths ----


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` fit into the items of ``a`` used as bins: then ``a`` is never the worse filling.

    Items that both have go into each other.  Then equal items are placed together, best fit; only where that
    fails and few items are left are all ways tried.  What stays undecided is not dominated, so it is kept.
    """
    bins, items = Counter(a), Counter(b)
    bins, items = bins - items, items - bins
    rooms = Counter(bins)
    for item in sorted(items, reverse=True):
        n = items[item]
        for room in sorted(r for r in rooms if r >= item):
            each = room // item
            full = min(rooms[room], n // each)
            part = n - full * each if 0 < n - full * each < each and full < rooms[room] else 0
            rooms[room] -= full + (part > 0)
            rooms[room - each * item] += full
            if part:
                rooms[room - part * item] += 1
            n -= full * each + part
            rooms += Counter()
            if n == 0:
                break
        if n:
            break
    else:
        return True
    left = tuple(sorted(items.elements(), reverse=True))
    return len(left) <= 16 and sum(left) <= sum(bins.elements()) and _fits(tuple(bins.elements()), left)


def _fits(bins: tuple[int, ...], items: tuple[int, ...]) -> bool:
    if not items:
        return True
    item, rest = items[0], items[1:]
    tried = set()
    for i, room in enumerate(bins):
        if room >= item and room not in tried:
            tried.add(room)
            if _fits(bins[:i] + (room - item,) + bins[i + 1 :], rest):
                return True
    return False


def best_fit(room: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """(length, how many) of the filling that takes the largest length that fits, as often as it can, and so on.

    Never cut short: its cost depends on the number of different lengths, not of items.
    """
    taken = []
    top = bisect_right(lengths, room) - 1
    while top >= 0:
        n = min(counts[lengths[top]], room // lengths[top])
        if n > 0:
            taken.append((lengths[top], n))
            room -= n * lengths[top]
        top = min(top, bisect_right(lengths, room)) - 1
    return taken


def fillings(room: int, lengths: list[int], counts: dict[int, int], width: int, visits: int) -> list[tuple[int, ...]]:
    """Up to ``width`` undominated fillings of ``room``, least waste first.

    The incumbent is the whole best-fit filling.  From it the search goes on to better ones and alternatives, the largest
    items first and each length as often as it can; only this search ends after ``visits`` choices.
    """
    first = best_fit(room, lengths, counts)
    found = [(room - sum(k * n for k, n in first), tuple(k for k, n in first for _ in range(n)))]
    seen = {found[0][1]}
    left = visits

    def enough() -> bool:
        return left <= 0 or (len(found) >= width and found[width - 1][0] == 0)

    def record(room: int, taken: tuple[tuple[int, int], ...]) -> None:
        filling = tuple(k for k, n in taken for _ in range(n))
        if filling not in seen:
            seen.add(filling)
            insort(found, (room, filling))

    def search(room: int, top: int, taken: tuple[tuple[int, int], ...]) -> None:
        """Goes on with the lengths up to place ``top``; lengths are taken in groups, so few calls are open at once."""
        nonlocal left
        top = min(top, bisect_right(lengths, room) - 1)
        if top >= 0 and lengths[top] == room and counts[room] > 0:
            return record(0, (*taken, (room, 1)))
        placed = False
        for at in range(top, -1, -1):
            item = lengths[at]
            for n in range(min(counts[item], room // item), 0, -1):
                if enough():
                    return
                left -= 1
                placed = True
                search(room - n * item, at - 1, (*taken, (item, n)))
                if n * item == room:
                    break  # fewer of them: what fills the rest is dominated by this length again
        last, n = taken[-1] if taken else (room + 1, 0)
        if not placed and (room < last or n == counts[last]):  # else one more would fit
            record(room, taken)

    search(room, len(lengths) - 1, ())
    out: list[tuple[int, ...]] = []
    for _, filling in found:
        if filling not in out and not any(dominates(other, filling) for other in out):
            out.append(filling)
            if len(out) == width:
                break
    return out


@dataclass
class Step:
    """``times`` sequences, each holding ``items`` (lengths, largest first)."""

    items: tuple[int, ...]
    times: int


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Bins that no packing of ``counts`` can do without.

    For each threshold k: items above ``capacity - k`` share a bin with nothing that is k or more, items over half a bin
    not with each other, and what is left of the latter's bins is all that the items from k to half a bin can save.
    """
    if not counts:
        return 0
    size = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in size.tolist()], np.int64)
    upto_n, upto = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    half = int(np.searchsorted(size, capacity // 2, "right"))
    k = np.concatenate([[0], size[:half]])
    low, high = np.searchsorted(size, k, "left"), np.searchsorted(size, capacity - k, "right")
    single, paired = upto_n[-1] - upto_n[high], upto_n[high] - upto_n[half]
    room = paired * capacity - (upto[high] - upto[half])
    rest = np.maximum(upto[half] - upto[low] - room, 0)
    return int((single + paired + -(-rest // capacity)).max())


def _taken(counts: dict[int, int], uses: Counter, times: int) -> dict[int, int]:
    left = dict(counts)
    for k, u in uses.items():
        left[k] -= u * times
        if not left[k]:
            del left[k]
    return left


def _choices(counts: dict[int, int], capacity: int, width: int, visits: int, after: tuple = ()) -> list[tuple[tuple[int, ...], int]]:
    """(items, how many bins) to go on with: undominated fillings around the largest length, least waste first.

    Each for as many bins as there are items, half as many, and so on to one; of a single filling there is no other use.
    Bins are in no order, so those with one largest length are filled in the order of their fillings: none comes that
    would stand before ``after``, the items of the bins filled last.
    """
    lengths = sorted(counts)
    first = lengths[-1]
    counts = counts | {first: counts[first] - 1}
    options = [(first, *rest) for rest in fillings(capacity - first, lengths, counts, width, visits)]
    counts[first] += 1
    place = lambda items: (-sum(items), items)
    if after and after[0] == first:
        options = [items for items in options if place(items) >= place(after)]
    out = []
    for items in sorted(options, key=place):
        most = min(counts[k] // u for k, u in Counter(items).items())
        while most:
            out.append((items, most))
            most = most // 2 if len(options) > 1 else 0
    return out


def branch_and_bound(counts: dict[int, int], capacity: int, incumbent: list[Step], nodes: int, width: int = 6, visits: int = 300) -> list[Step]:
    """A packing with fewer bins than ``incumbent``, or that itself.

    An explicit stack holds the choices still open at every bin filled so far, so that a branch that is cut goes back to the
    last of them.  A branch is cut when its bins and the least that the rest needs are no fewer than the best packing's, when
    its waste exceeds what a better packing may waste, or when its rest was reached before with as few bins.
    With ``nodes`` spent the best packing so far stands: exact where the search ends before, else as good as found.
    """
    total = sum(k * n for k, n in counts.items())
    best, best_bins = incumbent, sum(s.times for s in incumbent)
    bound, reached = lower_bound(counts, capacity), {}
    steps: list[Step] = []
    stack = [(counts, 0, 0, iter(_choices(counts, capacity, width, visits)))] if counts else []
    while stack and nodes > 0 and best_bins > bound:
        held, bins, waste, choices = stack[-1]
        chosen = next(choices, None)
        if chosen is None:
            stack.pop()
            if steps:
                steps.pop()
            continue
        items, times = chosen
        nodes -= 1
        rest = _taken(held, Counter(items), times)
        bins, waste = bins + times, waste + times * (capacity - sum(items))
        if waste > (best_bins - 1) * capacity - total or bins + lower_bound(rest, capacity) >= best_bins:
            continue
        if not rest:
            best, best_bins = [*steps, Step(items, times)], bins
            continue
        # The items matter, as they say which fillings may follow.
        key = (items, tuple(sorted(rest.items())))
        if reached.get(key, bins + 1) <= bins:
            continue
        reached[key] = bins
        steps.append(Step(items, times))
        stack.append((rest, bins, waste, iter(_choices(rest, capacity, width, visits, items))))
    return best


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, width: int = 3, visits: int = 400, dives: int = 6, nodes: int = NODES) -> list[Step]:
    """Pack ``histogram`` (length: documents) into few bins, by bin completion.

    Take the largest length left, enumerate undominated fillings of the rest of its bin, use one for several bins at once,
    go on.  First come at most ``dives`` descents (of ``width`` fillings found in ``visits`` steps or more each): one takes the
    best fit each time, the others leave it now and then.  The best of them is the incumbent of ``branch_and_bound``, which
    looks at ``nodes`` choices at most.  None of this goes on once the lower bound is reached.  Work depends
    on the number of different lengths, not of documents.
    """
    counts = {k: n for k, n in histogram.items() if n > 0}
    bound = lower_bound(counts, capacity)
    best = _descents(counts, capacity, width, visits, dives, bound)
    return best if sum(s.times for s in best) <= bound else branch_and_bound(counts, capacity, best, nodes)


def _descents(histogram: dict[int, int], capacity: int, width: int, visits: int, dives: int, bound: int) -> list[Step]:
    """The best packing of some descents without return."""
    total = sum(k * n for k, n in histogram.items())
    best: list[Step] | None = None
    best_bins = float("inf")
    for dive in range(dives):
        counts = dict(histogram)
        lengths = sorted(counts)
        steps: list[Step] = []
        bins = waste = turn = 0
        while lengths:
            if bins + -(-(total - (bins * capacity - waste)) // capacity) >= best_bins or waste > (best_bins - 1) * capacity - total:
                break
            first = lengths[-1]
            counts[first] -= 1
            options = fillings(capacity - first, lengths, counts, width, visits * (1 + dive))
            counts[first] += 1
            # Later descents leave the best fit now and then, each at its own places.
            turn += 1
            rest = options[(turn // dive) % len(options) if dive and turn % dive == 0 else 0]
            items = (first, *rest)
            uses = Counter(items)
            most = min(counts[k] // u for k, u in uses.items())
            # Half of what the counts allow, so that lengths stay mixed.
            times = max(1, (most + 1) // 2)
            for k, u in uses.items():
                counts[k] -= u * times
                if counts[k] == 0:
                    del counts[k]
                    lengths.pop(bisect_left(lengths, k))
            bins += times
            waste += times * (capacity - sum(items))
            steps.append(Step(items, times))
        if not lengths and bins < best_bins:
            best, best_bins = steps, bins
        if best_bins == bound:
            break
    return best or []


@dataclass
class Places:
    """Where the n-th document of a length goes; arrays sorted by (length, first number)."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    length: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        slot, turn = np.divmod(rank - self.first[at], self.times[at])
        return self.sequence[at] + turn, self.offset[at] + slot * self.length[at]


def places(steps: list[Step]) -> Places:
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for step in steps:
        offset = 0
        for length, n in Counter(step.items).items():
            first = used.get(length, 0)
            rows.append(((length << 44) + first, first, sequence, step.times, offset, length))
            used[length] = first + n * step.times
            offset += n * length
        sequence += step.times
    return Places(*(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True))) if rows else Places(*(np.zeros(0, np.int64) for _ in range(6)))


def numbered(pieces: DataFrame, most: int) -> DataFrame:
    """``pieces`` with ``rank``, counting from 0 within each length.

    A length may hold a third of all rows, so it is numbered in salted parts, each of which starts where
    the parts before it end.
    """
    salts = max(1, -(-most // ROWS_PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(64, salts))))
    sizes = stage(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "salt-sizes")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    return salted.withColumn("own", F.row_number().over(own) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("salt", "own", "before")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece.

    Null text counts as empty: such a document is the end id alone.  Repeated rows are packed as often as
    they occur; null ids are kept.  An empty table gives no rows.  Documents are only tokenised and cut where
    they are; the packing is found for the histogram of at most ``capacity`` lengths, which is all that reaches
    the driver, and the n-th document of each length then looks its place up.
    """
    pieces = stage(token_pieces(doc_text(docs, id_col, text_col), tokenizer, capacity), "token-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    whole = histogram.pop(capacity, 0)
    steps = complete_bins(histogram, capacity)
    if whole:
        steps.append(Step((capacity,), whole))
    where = places(steps)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        sequence, offset = where.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = numbered(pieces, max([whole, *histogram.values()], default=0))
    return ranked.withColumn("place", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "place.*")
