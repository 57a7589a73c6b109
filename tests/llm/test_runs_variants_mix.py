from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from checks.verify import compare, duck
from lamina.llm import mixing, queries, spelling
from lamina.llm.mixing import mix
from lamina.llm.periodic import lyndon_lengths, periodic_runs, run_digests, runs_in_texts, with_planted_periods
from lamina.llm.spelling import Borders, KdTree, spelling_groups, spelling_variants, word_counts
from tests.llm import fixtures as fx

ROWS = fx.corpus(11)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], fx.SCHEMA)


# ---- periodic runs ----


def plain_runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j - i + p
            # A root that is a power has a smaller period.
            if n >= max(least, 2 * p) and not any(p % q == 0 and w[i : i + p] == w[i : i + q] * (p // q) for q in range(1, p)):
                out.append((i, n, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, text: str | None) -> list[str]:
    w = fx.words_of(text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def run_row(doc_id: int | None, text: str | None) -> tuple:
    w = planted(doc_id, text)
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(runs), *one, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_lyndon_lengths():
    rng = random.Random(2)
    for _ in range(800):
        s = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(1, 28))]
        want = [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]
        assert lyndon_lengths(s, [i == 0 for i in range(len(s))]) == want, s
    # Two sequences in one call stay apart.
    assert lyndon_lengths([0, 1, 1, 2], [True, False, True, False]) == [2, 1, 2, 1]


def test_runs_of_random_texts():
    rng = random.Random(9)
    for _ in range(600):
        k, n = rng.choice([1, 2, 3, 4]), rng.randrange(1, 60)
        w = [f"w{rng.randrange(k)}" for _ in range(n)]
        a, p, least = rng.randrange(n), 1 + rng.randrange(12), rng.choice([2, 5, 12, 13])
        w = [w[a + (i - a) % p] if rng.random() < 0.98 and i >= a else x for i, x in enumerate(w)]
        found, text, _ = runs_in_texts([" ".join(w).encode(), b"", " ".join(w[::-1]).encode()], least)
        for k, words in ((0, w), (1, []), (2, w[::-1])):
            assert [tuple(r) for r in found[text == k].tolist()] == plain_runs(words, least)


def test_periodic_runs_of_documents(spark, empty):
    rows = [*ROWS, (9001, "a b " * 400 + "c " * 13 + "a b"), (9002, "x\ty\nx y " * 5), (None, "tick " * 20), (None, None), (-10, "p q r " * 9)]
    got = run_digests(periodic_runs(with_planted_periods(fx.frame(spark, rows, repeat=3)))).collect()
    want = [run_row(*r) for r in [*rows, *rows[:3]]]
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r[1] > 0 for r in want) > 15
    assert run_digests(periodic_runs(with_planted_periods(empty))).isEmpty()
    with pytest.raises(ValueError):
        periodic_runs(empty, min_length=1)


def test_one_very_long_period(spark):
    words = [f"w{i}" for i in range(30_000)]
    text = " ".join(words * 3 + words[:7])
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 90_007, 30_000)] and row["kept_text"] == " ".join(words)


# ---- spelling variants ----


def plain_variants(rows, drop: int | None = 199) -> list[tuple]:
    n: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(fx.LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = Counter({w: k for w, k in n.items() if len(w) >= 6 and k >= 5})
    near = {w: [] for w in n}
    for w in n:
        for v in n:
            if w < v and abs(len(w) - len(v)) <= 1:
                a, b = sorted((w, v), key=len)
                same = sum(x != y for x, y in zip(a, b, strict=False)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
                if same:
                    near[w].append(v)
                    near[v].append(w)
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= 5 * n[w] else None for w, v in best.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


def spelled(seed: int) -> list[tuple[int | None, str | None]]:
    """Documents of words, misspelt words, words with the same letters in other orders, and odd rows."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randrange(6, 11))) for _ in range(40)]
    base += ["".join(rng.sample("abcdef", 6)) for _ in range(200)]  # one vector
    base += ["".join(rng.sample("abcdeg", 6)) for _ in range(200)]  # and one beside it
    words = []
    for w in base:
        k = rng.choice([5, 6, 30, 160])
        words += [w] * k
        at = rng.randrange(len(w))
        words += [rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "y" + w[at + 1 :]])] * rng.randrange(1, 9)
    words += ["z" * 300] * 5 + ["z" * 301] * 30 + ["BIGGER", "bigger", "Bigger", "bIGGER", "bigges"] * 3 + ["ÀÀÀÀÀÀ"] * 6 + ["àààààà"] * 6
    rng.shuffle(words)
    docs = [(i, rng.choice([" ", "-", "\n"]).join(words[i * 60 : i * 60 + 60])) for i in range(-(-len(words) // 60))]
    return [*docs, (None, "orphan " * 7), (None, None), (7001, ""), (7002, "1234 中文 ok")]


@pytest.mark.parametrize("cell_words", [8_000, 40])
def test_spelling_variants(spark, empty, cell_words, monkeypatch):
    rows = spelled(4)
    monkeypatch.setattr(spelling, "CELL_WORDS", cell_words)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (cell_words,))
    docs = fx.frame(spark, rows, repeat=4)
    got = [tuple(r) for r in spelling_variants(docs, drop_one_in=199).collect()]
    want = plain_variants([*rows, *rows[:4]])
    assert Counter(got) == Counter(want)
    assert sum(r[1] is not None for r in want) > 20 and max(r[4] for r in want) > 2
    assert spelling_variants(empty).isEmpty()


def test_chains_of_forms_and_clashing_columns(spark):
    words = [("chained", 1000), ("chainedx", 200), ("chainedxy", 40), ("chainedxyz", 8), ("chainedxyzw", 8), ("quiet one", 3), ("ÿ" * 6, 2)]
    frame = spark.createDataFrame([(w, n, 1, "r") for w, n in words], "word string, n long, n_near int, root string")
    got = {r["word"]: tuple(r)[1:] for r in spelling_groups(frame).collect()}
    assert got["chainedxyz"] == ("chainedxy", "chained", 8, 2, 40) and got["chainedxyzw"] == (None, "chainedxyzw", 8, 1, None)
    assert got["quiet one"] == (None, "quiet one", 3, 0, None)


def test_cells_meet_every_near_word():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.choice([6, 7]))) for _ in range(3000)})
    borders = Borders(words[:500], len(words), 30)
    cells = {length: list(borders.cells(length, [w for w in words if len(w) == 6])) for length in (6, 7)}
    six = [w for w in words if len(w) == 6]
    home = {six[i]: (leaf, deals) for leaf, deals, asked, far in cells[6] for i in asked[far == 0]}
    assert set(home) == set(six) and len({h for h, _ in home.values()}) > 10
    reached = defaultdict(set)
    for leaf, _, asked, _ in cells[6]:
        for i in asked:
            reached[six[i]].add(leaf)
    for w in six[:200]:
        for v in six:
            if sum(x != y for x, y in zip(w, v, strict=True)) == 1:
                assert home[v][0] in reached[w]


def test_tree_range_search():
    rng = np.random.default_rng(5)
    vectors, asked = rng.integers(0, 4, (400, 6)).astype(np.int32), rng.integers(0, 4, (90, 6)).astype(np.int32)
    tree = KdTree(vectors, 8, tight=True)
    apart = np.abs(asked[:, None] - vectors[None]).sum(2)
    found = {(int(q), int(m)) for leaf, who, _ in tree.within(asked, 2) for q in who for m in leaf.items if apart[q, m] <= 2}
    assert found == {(int(q), int(m)) for q, m in zip(*np.nonzero(apart <= 2), strict=True)}


def test_counts_are_handed_on_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 1)
    rows = [(i, "sevenlet eightlet") for i in range(6)]
    assert {tuple(r) for r in word_counts(fx.frame(spark, rows)).collect()} == {("sevenlet", 6), ("eightlet", 6)}


# ---- source mix ----


def plain_mix(rows, weights=(5, 2, 1), most=3):
    """rows of (doc_id, text, source)."""
    md5 = lambda s: hashlib.md5(s.encode("utf-8", "surrogatepass")).hexdigest()
    docs = []
    for i, t, s in rows:
        u = (int(md5(f"{'' if i is None else i}|{md5(t or '')}")[:13], 16) + 0.5) / (1 << 52)
        docs.append((i, s, len(fx.words_of(t)), u))
    size: dict = defaultdict(int)
    for _, s, n, _ in docs:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full: set = set()
    while True:
        left, weight = sum(size.values()) - sum(most * size[s] for s in full), sum(w[s] for s in order if s not in full)
        over = {s for s in order if s in full or most * size[s] * weight < w[s] * left}
        if over == full:
            break
        full = over
    target = {s: float(most * size[s]) if s in full else w[s] * float(left) / float(weight) for s in order}
    out = []
    for s in order:
        rate = target[s] / size[s] if size[s] else 0.0
        copies, chance = int(rate), rate - int(rate)
        need, after = target[s] - copies * size[s], 0
        groups = defaultdict(list)
        for i, _, n, u in (d for d in docs if d[1] == s):
            q = (u / (1 - u)) / (chance / (1 - chance)) if chance else 0
            groups[(q, i is None, i or 0, n)].append((i, n))
        for key in sorted(groups):
            words = sum(n for _, n in groups[key])
            after += words
            more = chance > 0 and 2 * after - words < 2 * need
            out += [(i, n, size[s], target[s], n * (copies + more)) for i, n in groups[key]]
    return out


def sourced(spark, rows):
    full = [(i, t, None, s, None, "kept", "s", None) for i, t, s in rows]
    return spark.createDataFrame(full, fx.SCHEMA.replace("node string", "target string")).repartition(3)


@pytest.mark.parametrize("slots, task_rows, broadcast", [(1 << 12, 50_000, True), (2, 3, True), (4, 5, False)])
def test_source_mix(spark, monkeypatch, slots, task_rows, broadcast):
    monkeypatch.setattr(mixing, "SLOTS", slots)
    monkeypatch.setattr(mixing, "TASK_ROWS", task_rows)
    if not broadcast:
        monkeypatch.setattr(mixing, "fits_broadcast", lambda df: False)
    rng = random.Random(3)
    names = ["b", "a", "é", "Z", None, "", "small", "hot"]
    rows = [(i, t, "hot" if i % 3 == 0 else names[i % 7]) for i, t in ROWS]
    rows += [(5000 + i, fx.sentence(rng, 40), "hot") for i in range(200)] + [(9000, "tiny text", "small one"), (9001, None, "no words"), (9002, " \n", "no words")]
    rows += [(None, "no id here", "a"), (None, "no id there", "a"), *rows[:4], rows[0]]
    got = mix(sourced(spark, rows))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    close = lambda r: (*r[:3], float(f"{r[3]:.10g}"), r[4])
    have, want = Counter(close(tuple(r)) for r in got.collect()), Counter(close(r) for r in plain_mix(rows))
    assert have == want
    assert all(r[4] <= 3 * r[1] for r in have)


def test_source_mix_edges(spark, empty):
    assert mix(empty).isEmpty()
    only = mix(sourced(spark, [(1, "one two three", "s"), (2, None, "s")])).collect()
    assert sorted(tuple(r) for r in only) == [(1, 3, 3, 3.0, 3), (2, 0, 3, 3.0, 0)]
    nothing = mix(sourced(spark, [(1, None, None), (2, "", "x")])).collect()
    assert sorted(tuple(r) for r in nothing) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_source_mix_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    outcome = compare(spark, duck(sf), queries.QUERIES["op13_source_mix"], queries.ORACLE["op13_source_mix"], sf)
    assert outcome == "ok 1000", outcome


def test_mix_comes_near_its_targets(spark):
    rows = mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    per = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        per[(r["source_size"], r["target"])][0] += r["taken"]
        per[(r["source_size"], r["target"])][2] = max(per[(r["source_size"], r["target"])][2], r["size"])
    assert all(abs(taken - target) <= largest / 2 + 1 for (_, target), (taken, _, largest) in per.items())
