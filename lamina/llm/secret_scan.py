"""Secret scan: high-recall candidates, then a random forest trained on labelled findings removes false positives."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.staging import doc_text, stage

#: Labelled findings that the forest is fitted on, at most about this many of each label.
TRAINING_ROWS = 10_000
#: Words of the dictionary: those that make up this share of all word occurrences of the corpus, so at most 100,000 of them.
DICTIONARY_SHARE = 1e-5
#: And occur at least this often, so that a small table's every string is no word.
LEAST_OCCURRENCES = 3
THRESHOLD = 0.5
#: Characters before and after a candidate that are looked at.
CONTEXT = 48

#: Whole runs of key characters, whatever their length; the possessive repeat keeps very long ones linear.
_RUN = re.compile(r"[A-Za-z0-9_+/=.-]{16,}+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
#: A name and what assigns to it, at the start of a run.
_LEAD = re.compile(r"-{0,2}[A-Za-z_][A-Za-z0-9_.-]*+=++(?=.)")
_SITE = re.compile(r":=|=>|[=:]++")
_VALUE = re.compile(r"[ \t]*+(?:(?:bearer|basic|token)[ \t]++)?(?:\"((?:[^\"\\\n]|\\.)++)\"|'((?:[^'\\\n]|\\.)++)'|`([^`\n]++)`|[\"'`]?([^\s\"'`]++))", re.I)
_NAME = re.compile(r"(token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|bearer|private[_-]?key)\w*", re.I)
_ASSIGNED = re.compile(r"[=:]\s*[\"'`]?$|[\"'`]$")
_KNOWN = re.compile(r"^(AKIA|ASIA|ghp_|gho_|github_pat_|sk-|xox[abprs]-|glpat-|AIza|eyJ|-----BEGIN)")
_CLASS = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})

FEATURES = ("length", "transitions", "case_changes", "digit_share", "upper_share", "distinct_share", "entropy", "hex", "coverage", "slashes", "dots", "path_around", "known_prefix", "name_before", "assigned", "quoted_after", "word_before", "word_after")
#: What the seed rule goes by to call a finding true, and what follows from an assignment (a quote after, no word before):
#: a forest taught by that rule does not see it.
SEEDED_BY = ("known_prefix", "name_before", "assigned", "quoted_after", "word_before")
CANDIDATES = "doc_id long, start int, end int, masked string, " + ", ".join(f"{f} float" for f in FEATURES)


def dictionary(docs: DataFrame, share: float = DICTIONARY_SHARE) -> frozenset[str]:
    """Words of any length that make up ``share`` of all occurrences or more; at most 1 / ``share`` words reach the driver.

    A word is three letters or more, lower-cased, that stand alone but for quotes, brackets and marks around them.
    """
    alone = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![^\s\"'(\[])\p{L}{3,}+(?=[\"')\].,;:!?]*+(?:\s|$))"), F.lit(0))
    counted = stage(docs.select(F.explode(alone).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "secret-words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    frequent = counted.where(F.col("n") >= max(LEAST_OCCURRENCES, share * total))
    return frozenset(r["word"] for r in frequent.select("word").collect())


@lru_cache(maxsize=4)
def _lengths(words: frozenset[str]) -> list[int]:
    return sorted({len(w) for w in words}, reverse=True)


def coverage(candidate: str, words: frozenset[str]) -> float:
    """Share of the characters that lie in dictionary words, taking the longest word at each place."""
    low, at, covered, lengths = candidate.lower(), 0, 0, _lengths(words)
    while at < len(low):
        n = next((n for n in lengths if at + n <= len(low) and low[at : at + n] in words), 0)
        covered += n
        at += n or 1
    return covered / max(1, len(low))


def describe(text: str, start: int, end: int, words: frozenset[str]) -> list[float]:
    """The features of one candidate, in the order of ``FEATURES``."""
    s, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    shape = s.translate(_CLASS)
    n = len(s)
    counts = np.bincount(np.frombuffer(s.encode("utf-8", "replace"), np.uint8))
    share = counts[counts > 0] / counts.sum()
    near = before.split()[-3:]
    return [
        n,
        sum(a != b for a, b in zip(shape, shape[1:])) / n,
        sum({a, b} == {"a", "A"} for a, b in zip(shape, shape[1:])) / n,
        shape.count("0") / n,
        shape.count("A") / n,
        len(set(s)) / min(n, 64),
        float(-(share * np.log2(share)).sum()),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))),
        coverage(s, words),
        s.count("/") / n,
        s.count(".") / n,
        float("/" in before[-2:] or "/" in after[:1] or "\\" in before[-2:] or bool(re.search(r"\.\w{2,4}$", s))),
        float(bool(_KNOWN.match(s))),
        float(any(_NAME.search(w) for w in near)),
        float(bool(_ASSIGNED.search(before))),
        float(after[:1] in "\"'`" and after[:1] != ""),
        float(bool(near) and near[-1].isalpha()),
        float(bool(after.split()) and after.split()[0].strip(".,;:!?").isalpha()),
    ]


def _name_before(text: str, at: int) -> str:
    """The word that ends before place ``at``, past spaces, closing quotes and brackets."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    while end and text[end - 1] in "\"'`])":
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.-"):
        start -= 1
    return text[start:end]


def _run_places(text: str) -> Iterator[tuple[int, int]]:
    for m in _RUN.finditer(text):
        start, end = m.span()
        if m.group().startswith("-----BEGIN "):
            yield start, end
            continue
        while start < end and text[start] == ".":
            start += 1
        while start < end and text[end - 1] == ".":
            end -= 1
        while lead := _LEAD.match(text, start, end):
            # What stands before the sign is the name of what follows, but for a long string that names no secret.
            name_end = start + len(lead.group().rstrip("="))
            if name_end - start >= 16 and not _NAME.search(text, start, name_end):
                yield start, name_end
            start = lead.end()
        if end - start >= 24 or (end - start >= 16 and not text[start:end].isalpha()):
            yield start, end


def _assigned_places(text: str) -> Iterator[tuple[int, int]]:
    past = 0
    for m in _SITE.finditer(text):
        if m.start() < past or not _NAME.search(_name_before(text, m.start())):
            continue
        value = _VALUE.match(text, m.end())
        if value:
            start, end = value.span(value.lastindex)
            if value.lastindex == 4:
                while lead := _LEAD.match(text, start, end):
                    start = lead.end()
                past = end
                while end > start + 1 and text[end - 1] in ".,;)]}>":
                    end -= 1
            yield start, end


def places(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates: long runs of key characters, key headers, and whatever is assigned to a secret's name."""
    return sorted({*_run_places(text), *_assigned_places(text)})


def candidates(docs: DataFrame, words: frozenset[str]) -> DataFrame:
    """Stored rows of ``CANDIDATES``: unbroken strings of 16 key characters or more, key headers, and values of
    any length and characters that are assigned to a secret's name.  NAME= is no part of a candidate.

    ``masked`` shows the first four characters only, of short values a quarter, so that results do not spread secrets.
    Words without a digit are proposed from 24 characters on, unless they are assigned to such a name.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start, end in places(text):
                    n = end - start
                    shown = min(4, n // 4)
                    rows.append((doc_id, start, end, text[start : start + shown] + "*" * (n - shown), *describe(text, start, end, words)))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.float32()] * len(FEATURES)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "end", "masked", *FEATURES])

    return stage(docs.mapInArrow(scan, CANDIDATES), "secret-candidates")


def seed_labels(found: DataFrame) -> DataFrame:
    """Labels for findings that need no second look; null for the others.

    A value assigned to a secret's name, in random-looking characters, or with a known key prefix is
    one (short values cannot reach the entropy of long ones: they are held against that of their length); an unassigned string that is mostly dictionary words, or digits alone, or a path, is not.
    """
    random_like = (F.col("entropy") >= F.least(F.lit(3.0), 0.8 * F.log2("length"))) & (F.col("digit_share") > 0.05) & (F.col("coverage") < 0.4)
    named = (F.col("name_before") > 0) & (F.col("assigned") > 0)
    true = (named & random_like) | ((F.col("known_prefix") > 0) & random_like)
    false = (F.col("name_before") == 0) & (F.col("assigned") == 0) & ((F.col("coverage") >= 0.4) | (F.col("digit_share") == 1) | (F.col("path_around") > 0) | (F.col("digit_share") == 0))
    return found.withColumn("label", F.when(true, 1.0).when(false, 0.0))


def find_secrets(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, end, masked, score, is_secret): every candidate, places in code points.

    ``labels`` (doc_id, start, end, label 0 or 1) are findings that people have judged; without them those of
    ``seed_labels`` are used, and the forest does not see ``SEEDED_BY``: it learns what strings that are given a secret's name
    look like, and so judges those without a name too.  The forest is fitted on a sample of them bounded by ``TRAINING_ROWS`` per label and
    chosen by hash; ``is_secret``: its score reaches ``THRESHOLD``.  If the labels are all alike, that label is the
    score; without any, the score is null and every candidate counts as a secret.  Null text has no
    candidates, repeated rows give repeated findings, an empty table gives none.
    """
    rows = doc_text(docs, id_col, text_col)
    found = candidates(rows, dictionary(rows))
    if labels is None:
        known = seed_labels(found).where("label is not null")
    else:
        judged = labels.select(F.col("doc_id"), F.col("start").cast("int"), F.col("end").cast("int"), F.col("label").cast("double")).where("label is not null")
        known = found.join(judged.dropDuplicates(["doc_id", "start", "end"]), ["doc_id", "start", "end"])
    seen = [f for f in FEATURES if labels is not None or f not in SEEDED_BY]
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    score = F.lit(None).cast("double") if not counts else F.lit(float(next(iter(counts))))
    if len(counts) == 2:
        draw = F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, TRAINING_ROWS / n)))])
        sample = stage(known.where(draw < share[F.col("label")]), "secret-training")
        assemble = VectorAssembler(inputCols=seen, outputCol="features")
        model = RandomForestClassifier(numTrees=20, maxDepth=6, seed=11).fit(assemble.transform(sample).select("features", "label"))
        found = model.transform(assemble.transform(found))
        score = vector_to_array("probability")[1]
    return found.select("doc_id", "start", "end", "masked", score.alias("score")).withColumn("is_secret", F.coalesce(F.col("score") >= THRESHOLD, F.lit(True)))
