from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import jaccard, packing, suffixes, words
from lamina.llm.packed import KeyFilter, bucket_of, buckets_for, runs
from lamina.llm.queries import tokenizer_path
from tests.llm.fixtures import edited, sentence, shingle_set, words_of


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b\x1c\u00a0xyz0", max_size=60), max_size=6))
def test_words_are_split_at_ascii_space_only(texts):
    h, at = words.word_hashes([t.encode() for t in texts])
    assert np.diff(at).tolist() == [len(words_of(t)) for t in texts]
    names = [w for t in texts for w in words_of(t)]
    assert len(set(h.tolist())) == len(set(names))
    assert all((a == b) == (x == y) for a, x in zip(names, h.tolist()) for b, y in zip(names, h.tolist()))


def test_long_words_and_shingles():
    h, _ = words.word_hashes([b"x" * 100_001 + b" " + b"x" * 100_000, b"a b c d e f"])
    assert len(set(h.tolist())) == 8
    assert len(words.shingles(h[2:])) == 2 and len(words.shingles(h[:2])) == 1 and len(words.shingles(h[:0])) == 0


def test_linked_sets_share_a_chosen_signature():
    """Whatever the order of signatures, linked sets have one in common; sketches never rule them out."""
    rng = random.Random(3)
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 17, 31, 32, 33, 60, 64, 90, 130, 250, 513]:
        for _ in range(12):
            base = sentence(rng, size + 4)
            w = base.split(" ")
            other = edited(rng, base, rng.randrange(0, 1 + size // 20)) if rng.random() < 0.6 else " ".join(w[: len(w) - rng.randrange(0, 1 + size // 4)])
            a, b = shingle_set(base), shingle_set(other)
            linked = 100 * len(a & b) >= 75 * len(a | b)
            s, at = jaccard.shingle_sets([base.encode(), other.encode()])
            sketch = np.array([rng.randrange(3) for _ in range(1 << jaccard.SKETCH_BITS)])
            e, owner, place, sig = jaccard.signatures(s, at)
            rows, chosen = jaccard.chosen(e, owner, place, sig, sketch)
            common = set(chosen[e.doc[rows] == 0].tolist()) & set(chosen[e.doc[rows] == 1].tolist())
            x, y = (s[at[i] : at[i + 1]] for i in (0, 1))
            assert (len(x), len(y)) == (len(a), len(b))
            if linked:
                assert common
                assert jaccard.odd_distance(jaccard.odd_sketch(x), jaccard.odd_sketch(y)) * 7 <= len(x) + len(y)


def test_phrase_borders_depend_on_the_string_alone():
    rng = random.Random(9)
    shared = sentence(rng, 200).encode()
    parse = suffixes.Parse([sentence(rng, 40).encode() + shared, shared, sentence(rng, 9).encode() + shared[30:], b"ab" * 700])
    assert ((0 <= parse.low) & (parse.low <= parse.high) & (parse.high <= suffixes.SIDE)).all()
    covered = np.bincount(parse.doc, parse.high - parse.low + 1)
    assert covered.tolist() == [max(0, n - 399) for n in parse.sizes.tolist()]
    inside = [set((parse.border[parse.doc == d] - parse.offsets[d] - shift).tolist()) for d, shift in ((0, parse.sizes[0] - len(shared)), (1, 0))]
    assert len(inside[0] & inside[1]) >= 0.8 * len(inside[1])


def test_ranges_and_filter():
    assert [x.tolist() for x in runs(np.array([5, 0, 3, 20]), 4)] == [[0, 20], [9, 24]]
    assert buckets_for(0) == 256 and buckets_for(10**12) > 60_000
    assert bucket_of(np.array([0, 2**64 - 1], np.uint64), 256).tolist() == [0, 255]
    assert not KeyFilter([], 256).holds(np.array([1, 2**63], np.uint64)).any()


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=25))
def test_bins_hold_every_document_once(histogram):
    steps = packing.complete_bins(histogram, 64)
    used: dict[int, int] = {}
    for step in steps:
        assert sum(step.items) <= 64 and step.times > 0
        for k in step.items:
            used[k] = used.get(k, 0) + step.times
    assert used == histogram
    bins, bound = sum(s.times for s in steps), -(-sum(k * n for k, n in histogram.items()) // 64)
    assert bound <= bins <= 2 * bound


def test_bins_reach_the_bound_on_common_lengths():
    rng = random.Random(1)
    histogram: dict[int, int] = {}
    for _ in range(20_000):
        n = min(2047, int(rng.lognormvariate(6, 1)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    bins = sum(s.times for s in packing.complete_bins(histogram))
    assert bins <= -(-sum(k * n for k, n in histogram.items()) // 2048) + 1


@pytest.mark.parametrize("histogram", [{1: 5000}, {3: 1_000_000}, {1: 700_000, 2: 90_000, 5: 40_001, 700: 13, 1500: 900, 2047: 5}])
def test_short_documents_fill_their_bins(histogram):
    steps = packing.complete_bins(histogram)
    used: dict[int, int] = {}
    for step in steps:
        assert sum(step.items) <= 2048
        for k in step.items:
            used[k] = used.get(k, 0) + step.times
    assert used == histogram
    assert sum(s.times for s in steps) <= -(-sum(k * n for k, n in histogram.items()) // (2048 - 2048 % min(histogram))) + 1


def test_the_first_filling_is_whole_whatever_the_limit():
    assert packing.fillings(2047, [1], {1: 5000}, 3, 0) == [(1,) * 2047]
    assert packing.fillings(1001, [2, 500], {2: 10_000, 500: 1}, 3, 1)[0] == (500, *(2,) * 250)
    assert packing.dominates((2,) * 1000, (1,) * 2000) and not packing.dominates((1,) * 2000, (2,) * 1000)


def test_dominance():
    assert packing.dominates((7,), (4, 3)) and packing.dominates((5, 4), (4, 4)) and not packing.dominates((4, 4), (5, 3))
    assert packing.fillings(7, [3, 4, 7], {3: 2, 4: 2, 7: 1}, 3, 100) == [(7,)]


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 5000])
def test_only_the_first_piece_is_short(n):
    pieces = packing.cut(n)
    assert sum(k for _, k in pieces) == n and all(k == 2048 for _, k in pieces[1:])
    assert [s for s, _ in pieces] == [sum(k for _, k in pieces[:i]) for i in range(len(pieces))]


def held(steps, capacity=2048):
    """Documents of each length in the packing, and its bins."""
    assert all(sum(s.items) <= capacity and s.times > 0 for s in steps)
    lengths: Counter = Counter()
    for s in steps:
        for k in s.items:
            lengths[k] += s.times
    return dict(lengths), sum(s.times for s in steps)


def fewest_bins(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in sorted({r for r in bins if r >= items[i]}):
            k = bins.index(room)
            go(i + 1, [*bins[:k], room - items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


def test_branches_find_what_descents_miss():
    histogram = {700: 3000, 690: 500, 660: 700, 1400: 900, 1300: 300}
    assert held(packing.complete_bins(histogram, nodes=0)) == (histogram, 2975)
    assert held(packing.complete_bins(histogram)) == (histogram, 2913)
    assert packing.lower_bound(histogram) <= 2913


def test_small_packings_are_exact():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37, 100])
        items = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(max(1, capacity // 5), max(2, capacity // 2)) for _ in range(rng.randrange(1, 12))]
        lengths, bins = held(packing.complete_bins(dict(Counter(items)), capacity), capacity)
        least = fewest_bins(items, capacity)
        assert lengths == dict(Counter(items)) and packing.lower_bound(lengths, capacity) <= least == bins, items


def test_lower_bound_of_nothing_and_of_large_items():
    assert packing.lower_bound({}) == 0 and packing.complete_bins({}) == []
    assert packing.lower_bound({1400: 900, 1300: 300}) == 1200


def test_ranks_give_the_ids_of_the_tokenizer(spark):
    tokenizer = packing.TextTokenizer(tokenizer_path())
    assert tokenizer.ranks is not None
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = random.Random(5)
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(128), 32, 10, 39, 115])) for _ in range(30)) for _ in range(2000)]
    texts += ["", " ", "a <|endoftext|> b", "x" * 5000, " " * 5000, "中文 ok", "it's 3'll\u00a0\u0085x"]
    for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids, text[:50]
    assert list(np.frombuffer(next(tokenizer.encode(["<|endoftext|>"])), "<u4")) == [50256]
