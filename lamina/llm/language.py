"""Language identification: nearest of several clustered TF-IDF centroids per language, with rejection by distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.staging import col

UNDETERMINED = "und"
#: Hashed n-gram features; the size of every vector, whatever the corpus.
DIMENSIONS = 1 << 13
#: Documents of one language that its centroids are fitted on, at most about this many.
SAMPLE_PER_LANGUAGE = 500
CENTROIDS = 4
#: A text is rejected where its cosine is under this share of the lowest one in the fitting sample.
REJECT_SHARE = 0.3

_LETTER = re.compile(r"[^\W\d_]")
_KEPT = np.full(256, 32, np.uint8)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and counts of the byte 1-, 2- and 3-grams of the lower-cased letters of a text.

    Anything but letters counts as a word border, so digits and signs do not matter.
    """
    raw = _KEPT[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)]
    keep = raw != 32
    keep[1:] |= raw[:-1] != 32
    b = raw[keep].astype(np.uint32)
    grams = [b, b[:-1] << np.uint32(8) | b[1:] | np.uint32(1 << 30), b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:] | np.uint32(1 << 31)]
    with np.errstate(over="ignore"):
        slots = (np.concatenate(grams) * np.uint32(2654435761)) >> np.uint32(32 - 13)
    counts = np.bincount(slots, minlength=DIMENSIONS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weighted(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Values of the unit TF-IDF vector at the features found."""
    value = (1 + np.log(counts)) * idf[found]
    norm = np.sqrt(value @ value)
    return (value / norm if norm else value).astype(np.float32)


@dataclass
class LanguageModel:
    """``centroids`` has one row per cluster, ``languages`` and ``floors`` the language and least cosine of each."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    floors: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); ``und`` and 0 without any letter, which is rejected, or without a model."""
        if text is None or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        if not self.languages:
            return UNDETERMINED, 0.0, False
        found, counts = ngram_counts(text)
        cosines = self.centroids[:, found] @ weighted(found, counts, self.idf)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, bool(score < self.floors[best])


def _cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means, seeded with the points farthest from those chosen before."""
    k = min(k, len(vectors))
    mean = vectors.mean(axis=0)
    chosen = [int(np.argmax(vectors @ mean))]
    while len(chosen) < k:
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(axis=1))))
    centroids = vectors[chosen].copy()
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        for j in range(k):
            own = vectors[nearest == j]
            if len(own):
                centroids[j] = own.sum(axis=0)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per feature, one row per feature and task."""
    seen = np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen[ngram_counts(text)[0]] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS)), pa.array(seen)], ["feature", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, rows = batch.column(0).to_pylist(), [ngram_counts(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(lang, pa.string()),
                pa.array([f.astype(np.int32).tobytes() for f, _ in rows], pa.binary()),
                pa.array([c.astype(np.int32).tobytes() for _, c in rows], pa.binary()),
            ],
            ["lang", "found", "counts"],
        )


def fit_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows of ``labelled`` that have text with a letter and a language.

    Document frequencies cover all rows.  Centroids are fitted on a sample bounded by
    ``SAMPLE_PER_LANGUAGE``: rows whose hashed id is under the language's share, so the choice does not
    depend on how rows are dealt out.  Only the frequencies (a fixed number) and the sample reach the driver.
    """
    rows = labelled.select(col(id_col).alias("id"), col(lang_col).alias("lang"), col(text_col).alias("text"))
    rows = rows.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return LanguageModel(np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS), np.float32), [])
    frequency = rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df = np.zeros(DIMENSIONS)
    for r in frequency.collect():
        df[r["feature"]] = r["n"]
    idf = np.log((1 + sum(totals.values())) / (1 + df)) + 1
    share = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE_PER_LANGUAGE / n)))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = rows.where(draw < share[F.col("lang")]).select("lang", "text").mapInArrow(_sampled, "lang string, found binary, counts binary")
    vectors: dict[str, list[np.ndarray]] = {}
    for r in drawn.collect():
        found, counts = np.frombuffer(r["found"], np.int32), np.frombuffer(r["counts"], np.int32)
        dense = np.zeros(DIMENSIONS, np.float32)
        dense[found] = weighted(found, counts, idf)
        vectors.setdefault(r["lang"], []).append(dense)
    centroids, languages, floors = [], [], []
    for lang in sorted(vectors):
        # One order whatever the tasks' order was, so that a rerun gives the same centroids.
        points = np.stack(sorted(vectors[lang], key=lambda v: v.tobytes()))
        own = _cluster(points, CENTROIDS)
        lowest = float((points @ own.T).max(axis=1).min())
        centroids.append(own)
        languages += [lang] * len(own)
        floors += [REJECT_SHARE * lowest] * len(own)
    return LanguageModel(idf, np.concatenate(centroids), languages, np.array(floors))


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` plus a last column ``lang_prediction`` (lang, score, rejected); nothing is shuffled."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(texts):
        import pandas as pd

        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "rejected"])

    return docs.withColumn("lang_prediction", predict(col(text_col)))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, rejected), one per row of ``docs``.

    Learned from the rows that are not held out and have id, text and language; id, source and language are
    never inputs of a prediction.  ``lang_pred`` is ``und`` with score 0 where the text is null or has no
    letter, or where nothing could be learned.  ``rejected``: no letter, or too far from every centroid.
    Repeated rows get equal rows; an empty table gives none.
    """
    model = fit_languages(docs.where(~held_out(id_col) & col(id_col).isNotNull()), id_col, text_col, lang_col)
    rows = docs.select(col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), col(text_col).alias("text"))
    p = F.col("lang_prediction")
    return predict_languages(rows, model).select("doc_id", "held_out", p["lang"].alias("lang_pred"), p["score"].alias("score"), p["rejected"].alias("rejected"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    model = fit_languages(docs.where(~held_out(id_col) & col(id_col).isNotNull()), id_col, text_col, lang_col)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        return pd.Series([not model.predict(t)[2] for t in texts], dtype=bool)

    return docs.where(known(col(text_col)))
