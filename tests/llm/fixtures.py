"""Small corpora with copies, edits, odd white space, nulls and clashing columns; and slow, plain versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, Slot_ string, node string"


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text: str | None) -> frozenset:
    w = words_of((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def sentence(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed: int = 5) -> list[tuple[int | None, str | None]]:
    """Documents of all sizes, groups of near copies around one text, exact copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    docs: list[str | None] = [sentence(rng, rng.randrange(1, 160)) for _ in range(60)]
    for size in (12, 40, 90, 200):
        base = sentence(rng, size)
        docs.append(base)
        docs += [edited(rng, base, rng.randrange(1, max(2, size // 14))) for _ in range(9)]
    passage = sentence(rng, 60)
    docs += [f"{sentence(rng, rng.randrange(30, 80))} {passage} {sentence(rng, 20)}" for _ in range(12)]
    docs += [docs[3], docs[3] + "\n", (docs[3] or "").replace(" ", " \t", 1), (docs[3] or "").upper()]
    docs += [None, "", "   \n", "one", "One", "a b c d", "A b\tc d", "tick " * 300, "tick " * 120 + "tock " * 90, "x" * 5000, "é" * 900, sentence(rng, 3000)]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs, strict=True))


def frame(spark, rows, repeat: int = 0):
    """The rows with further columns, some named like helper columns; the first ``repeat`` rows come twice."""
    rows = [*rows, *rows[:repeat]]
    full = [(i, t, None if i is None or i % 7 == 0 else "en", None, None, "kept", "s", None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def components(rows) -> dict[int, int]:
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def repeated_words(rows) -> dict[int, list[str]]:
    """Kept words per document when every later 20-word window goes."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w, gone = words_of(t), set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def repeated_bytes(rows) -> dict[int, tuple[int, bytes]]:
    """(runs removed, bytes kept) per document when every 400-byte string that starts twice goes."""
    texts = {i: (t or "").encode() for i, t in rows}
    count = Counter(t[k : k + 400] for t in texts.values() for k in range(len(t) - 399))
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        out[i] = (len(re.findall(b"\1+", bytes(gone))), bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out
