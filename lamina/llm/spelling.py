"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.staging import doc_text, stage
from lamina.llm.words import mixed

U64 = np.uint64
#: Code points a word has at least, and times it occurs at least, to count.
MIN_LETTERS = 6
MIN_COUNT = 5
#: A word's form occurs this many times as often as the word, at least.
FORM_RATIO = 5
#: One edit changes the letter counts by this much in all, at most.
RADIUS = 2
#: Words that one search task holds, about.
CELL_WORDS = 8_000
#: About so many words (twice as many at most), drawn by hash, place the borders between tasks; any borders give the same result.
BORDER_SAMPLE = 40_000
#: Different words that a counting task holds before it hands them on.
HELD_WORDS = 200_000
#: Hash entries compared at once inside a search task.
CHUNK = 1 << 21

_RUN = re.compile("[a-zÀ-ÿ]+")


# ---- counting ----


def _tokens(doc_id: object, text: str, drop_one_in: int | None) -> Iterator[tuple[str, int]]:
    """The letter runs of a text and how often each occurs; A-Z are lowered and no other letters."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(lowered)).items():
        if drop_one_in:
            h = zlib.crc32(run.encode(), start)
            if h % drop_one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, drop_one_in: int | None = None) -> DataFrame:
    """Rows (word, n): the words of all texts that are long and frequent enough, each once.

    Tasks add up what they see, up to a bounded number of words at a time, before words are shuffled.  With
    ``drop_one_in`` a letter is left out of about one in so many runs, chosen by the checksum of ``<doc_id>:<run>``.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in _tokens(doc_id, text, drop_one_in):
                    if len(word) >= min_letters:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield handed()
        yield handed()

    return docs.mapInArrow(emit, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- k-d trees ----


@dataclass
class Node:
    """A box of letter counts, and either two halves or the number of a leaf with its vectors."""

    low: np.ndarray
    high: np.ndarray
    halves: tuple[Node, Node] | None = None
    leaf: int = -1
    items: np.ndarray | None = None


class KdTree:
    """Vectors of small counts in boxes, halved at the median of the count that varies most.

    ``tight`` boxes hold the given vectors and no more; else the boxes share out all of space, so that any vector
    lies in exactly one leaf.
    """

    def __init__(self, vectors: np.ndarray, leaf_size: int, tight: bool):
        self.leaves: list[Node] = []
        width = vectors.shape[1]
        self.root = Node(np.full(width, 0, np.int32), np.full(width, np.iinfo(np.int32).max, np.int32))
        waiting = [(self.root, np.arange(len(vectors)))]
        while waiting:
            node, items = waiting.pop()
            own = vectors[items]
            if tight and len(items):
                node.low, node.high = own.min(0), own.max(0)
            spread = own.var(0) if len(items) > leaf_size and width else np.zeros(1)
            d = int(spread.argmax())
            if not spread[d]:
                node.leaf, node.items = len(self.leaves), items
                self.leaves.append(node)
                continue
            # The median, or the count below it where nothing would be left above.
            border = int(np.partition(own[:, d], len(own) // 2)[len(own) // 2])
            border = border if (own[:, d] > border).any() else int(own[:, d][own[:, d] < border].max())
            below = own[:, d] <= border
            halves = Node(node.low, node.high.copy()), Node(node.low.copy(), node.high)
            halves[0].high[d], halves[1].low[d] = border, border + 1
            node.halves = halves
            waiting += [(halves[0], items[below]), (halves[1], items[~below])]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[Node, np.ndarray, np.ndarray]]:
        """Leaves whose box is within ``radius`` (sum of differences) of queries, those queries, and how far they are."""
        waiting = [(self.root, np.arange(len(queries)))]
        while waiting:
            node, asked = waiting.pop()
            q = queries[asked]
            far = (np.maximum(node.low - q, 0) + np.maximum(q - node.high, 0)).sum(1, dtype=np.int64)
            near = far <= radius
            asked, far = asked[near], far[near]
            if not len(asked):
                continue
            if node.halves is None:
                yield node, asked, far
            else:
                waiting += [(half, asked) for half in node.halves]


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length)


def _vectors(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """How often each letter of ``alphabet`` occurs in each word; other letters are left out."""
    out = np.zeros((len(codes), len(alphabet)), np.int32)
    if len(alphabet):
        at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
        for j in range(codes.shape[1]):
            known = alphabet[at[:, j]] == codes[:, j]
            out[np.flatnonzero(known), at[known, j]] += 1
    return out


# ---- dealing words out to search tasks ----


class Borders:
    """For each length, a tree whose leaves are the cells that words of that length are dealt out to.

    A leaf with more words than one task should hold is dealt out once more, by a checksum of the word.
    """

    def __init__(self, sample: list[str], total: int, cell_words: int):
        self.alphabet = np.unique(np.frombuffer("".join(sample).encode("utf-32-le", "surrogatepass"), "<u4"))
        self.trees: dict[int, tuple[KdTree, list[int]]] = {}
        share = max(1.0, total / max(1, len(sample)))  # words that one word of the sample stands for
        by_length: dict[int, list[str]] = {}
        for w in sample:
            by_length.setdefault(len(w), []).append(w)
        for length, words in by_length.items():
            tree = KdTree(_vectors(_codes(words, length), self.alphabet), max(8, int(cell_words / share)), tight=False)
            self.trees[length] = tree, [max(1, round(len(leaf.items) * share / (4 * cell_words))) for leaf in tree.leaves]
            for leaf in tree.leaves:
                leaf.items = None

    def cells(self, length: int, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(leaf, deals, which words reach it, how far they are) among cells of words with ``length`` letters."""
        if length not in self.trees:
            yield 0, 1, np.arange(len(words)), np.full(len(words), length - len(words[0]))
            return
        tree, deals = self.trees[length]
        vectors = _vectors(_codes(words, len(words[0])), self.alphabet)
        for node, asked, far in tree.within(vectors, RADIUS):
            yield node.leaf, deals[node.leaf], asked, far + (length - len(words[0]))


DEALT = "length int, leaf int, deal int, member boolean, word string, n long"


def _dealt(words: DataFrame, borders: Borders) -> DataFrame:
    """Each word as a member of its own cell, and as a query of every cell that may hold a word one edit away.

    Words of one length are searched for among those of that length and those with one letter more.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[tuple[str, int]]] = {}
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_length.setdefault(len(w), []).append((w, n))
            for own, rows in by_length.items():
                words = [w for w, _ in rows]
                counts = np.array([n for _, n in rows], np.int64)
                held = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.int64)
                text = pa.array(words, pa.string())
                for length in (own, own + 1):
                    for leaf, deals, asked, far in borders.cells(length, words):
                        for deal in range(deals):
                            member = (far == 0) & (held[asked] % deals == deal)
                            k = len(asked)
                            fixed = [pa.array(np.full(k, v, np.int32)) for v in (length, leaf, deal)]
                            yield pa.RecordBatch.from_arrays([*fixed, pa.array(member), text.take(pa.array(asked)), pa.array(counts[asked])], DEALT_NAMES)

    return words.mapInArrow(emit, DEALT)


DEALT_NAMES = [f.strip().split(" ")[0] for f in DEALT.split(",")]

# ---- searching one cell ----


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length: hash of each word, and for each place hashes of the word with that letter left open, and taken out."""
    n, length = codes.shape
    key = mixed(np.arange(1, length + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        here = mixed(codes.astype(U64) * U64(0xD6E8FEB86659FD93) + key)
        shifted = np.zeros_like(here)
        shifted[:, 1:] = mixed(codes[:, 1:].astype(U64) * U64(0xD6E8FEB86659FD93) + key[:-1])
        whole = here.sum(1, dtype=U64)
        opened = mixed((whole[:, None] - here) ^ key)
        before = np.cumsum(here, 1, dtype=U64) - here
        after = shifted.sum(1, dtype=U64)[:, None] - np.cumsum(shifted, 1, dtype=U64)
        return mixed(whole), opened, mixed(before + after)


class _Side:
    """Words of one length in a cell: distinct letter-count vectors, and hash entries by (vector, letter)."""

    def __init__(self, which: np.ndarray, codes: np.ndarray, alphabet: np.ndarray):
        self.which, self.codes = which, codes
        self.vectors, self.of = np.unique(_vectors(codes, alphabet), axis=0, return_inverse=True)
        self.of = self.of.ravel()
        self.whole, self.opened, self.without = _places(codes)
        letter = np.searchsorted(alphabet, codes)
        slot = (self.of[:, None] * len(alphabet) + letter).ravel()
        self.order = np.argsort(slot, kind="stable")
        self.slots = slot[self.order]
        self.letters = len(alphabet)

    def entries(self, vector: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end, in ``order``, of the places at which words of the vectors have the letters."""
        slot = vector * self.letters + letter
        return np.searchsorted(self.slots, slot, "left"), np.searchsorted(self.slots, slot, "right")


def _expanded(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each comes from."""
    size = end - first
    owner = np.repeat(np.arange(len(size)), size)
    return first[owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner], owner


def _matched(pair_a: np.ndarray, hash_a: np.ndarray, word_a: np.ndarray, pair_b: np.ndarray, hash_b: np.ndarray, word_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of both sides that belong to one pair of vectors and have one hash."""
    with np.errstate(over="ignore"):
        a, b = (mixed(h + mixed(p.astype(U64) + U64(7))) for p, h in ((pair_a, hash_a), (pair_b, hash_b)))
    order = np.argsort(b, kind="stable")
    b, word_b = b[order], word_b[order]
    at, owner = _expanded(np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right"))
    return word_a[owner], word_b[at]


def _near(queries: _Side, members: _Side, alphabet: np.ndarray, tree: KdTree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member), as places within their sides, that are one edit apart.

    Members have as many letters as the queries, or one more.  The tree gives pairs of vectors whose counts
    differ as one edit makes them differ; that says which letters to compare the order around.
    """
    longer = members.codes.shape[1] - queries.codes.shape[1]
    found_u, found_v = [], []
    for leaf, asked, _ in tree.within(queries.vectors, RADIUS):
        for at in range(0, len(asked), 4096):
            part = asked[at : at + 4096]
            apart = np.abs(queries.vectors[part][:, None, :] - members.vectors[leaf.items][None, :, :]).sum(2)
            u, v = np.nonzero(apart == (1 if longer else 2))
            found_u.append(part[u])
            found_v.append(leaf.items[v])
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_u, found_v))
    out_a, out_b = [], []
    sizes = np.bincount(queries.of, minlength=len(queries.vectors)), np.bincount(members.of, minlength=len(members.vectors))
    cost = np.cumsum(sizes[0][u] + sizes[1][v]) if len(u) else np.zeros(0, np.int64)
    borders = np.unique(np.searchsorted(cost, np.arange(0, (cost[-1] if len(cost) else 0) + CHUNK, CHUNK)))
    words_of = np.argsort(queries.of, kind="stable")
    word_at = np.concatenate([[0], np.cumsum(sizes[0])])
    for x, y in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        pu, pv = u[x:y], v[x:y]
        differ = members.vectors[pv] - queries.vectors[pu]
        at_b, pair_b = _expanded(*members.entries(pv, differ.argmax(1)))
        place_b = members.order[at_b]
        width = members.codes.shape[1]
        if longer:
            at_a, pair_a = _expanded(word_at[pu], word_at[pu + 1])
            word_a = words_of[at_a]
            hash_a, hash_b = queries.whole[word_a], members.without.ravel()[place_b]
        else:
            at_a, pair_a = _expanded(*queries.entries(pu, differ.argmin(1)))
            place_a = queries.order[at_a]
            word_a = place_a // width
            hash_a, hash_b = queries.opened.ravel()[place_a], members.opened.ravel()[place_b]
        a, b = _matched(pair_a, hash_a, word_a, pair_b, hash_b, place_b // width)
        out_a.append(a)
        out_b.append(b)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
    if len(a):
        # A letter that stands twice in a row can be taken out at either place.
        a, b = np.unique(np.stack([a, b]), axis=1)
    return a, b


FOUND = "word string, n_near long, best_n long, best string"


def _search(table: pa.Table) -> pa.Table:
    """For the words of one cell: how many near words they have among its members, and the most frequent of these."""
    words = table.column("word").to_pylist()
    n = np.array(table.column("n").to_pylist(), np.int64)
    member = np.array(table.column("member").to_pylist(), bool)
    length = int(table.column("length")[0].as_py())
    size = np.array([len(w) for w in words])
    # The most frequent word has rank 0, of equally frequent ones the first.
    by_rank = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[by_rank] = np.arange(len(words))
    alphabet = np.unique(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4"))
    one, other = [], []
    own = np.flatnonzero(member)
    if len(own):
        members = _Side(own, _codes([words[i] for i in own], length), alphabet)
        tree = KdTree(members.vectors, 16, tight=True)
        for asked in (np.flatnonzero(size == length), np.flatnonzero(size == length - 1)):
            if not len(asked):
                continue
            letters = int(size[asked[0]])
            queries = _Side(asked, _codes([words[i] for i in asked], letters), alphabet)
            a, b = _near(queries, members, alphabet, tree)
            one.append(asked[a])
            other.append(own[b])
            if letters < length:  # longer words do not ask here for shorter ones
                one.append(own[b])
                other.append(asked[a])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, other))
    order = np.lexsort((rank[b], a))
    a, b = a[order], b[order]
    which, first, count = np.unique(a, return_index=True, return_counts=True)
    best = b[first]
    columns = [[words[i] for i in which], count, n[best], [words[i] for i in best]]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """Rows (word, n_near, best, best_n) of the words of stored ``words`` (word, n; each word once) that have near words.

    ``best`` is the most frequent near word, of equally frequent ones the first in code-point order.
    """
    total = words.count()
    one_in = max(1, total // BORDER_SAMPLE)
    picked = words.select("word").where(F.pmod(F.xxhash64("word"), F.lit(one_in)) == 0).orderBy("word")
    borders = Borders([r["word"] for r in picked.collect()], total, cell_words)
    found = _dealt(words.select("word", "n"), borders).groupBy("length", "leaf", "deal").applyInArrow(_search, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    met = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return met.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


# ---- groups ----


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of stored (word, form): forms followed to the last word, by doubling.

    Each step is at least ``FORM_RATIO`` times as frequent, so chains are short and so are the rounds.
    """
    held = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        held = stage(held.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if held.where("moved").isEmpty():
            return held.select("word", "root")
        held = held.drop("moved")


def spelling_groups(words: DataFrame, form_ratio: int = FORM_RATIO) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one per row of ``words`` (word, n).

    Two words are near if one code point put in, taken out or replaced makes one the other.  A word's form is its near
    word that occurs most (of equals the first in code-point order), if it occurs ``form_ratio`` times as often as the
    word; else form and form_n are null.  The root is the last form of the chain, or the word itself.  Words
    must be there once each, without nulls (as ``word_counts`` gives them); other columns are not read.  An empty
    table gives no rows.
    """
    held = stage(words.select("word", "n"), "words")
    near = stage(near_words(held), "near-words")
    joined = held.join(near, "word", "left")
    fits = F.col("best_n") >= F.col("n") * form_ratio
    rows = joined.select(
        "word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n")
    )
    rows = stage(rows, "forms")
    ends = roots(rows.where("form is not null"))
    out = rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, drop_one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spelling_groups`` of the words of all texts.

    Words are runs of Latin letters, A-Z lowered.  Null and empty texts have none; repeated rows count each time; a null id
    is written as nothing where checksums of ids are taken.  An empty table gives no rows.
    """
    return spelling_groups(word_counts(doc_text(docs, id_col, text_col), drop_one_in=drop_one_in))
