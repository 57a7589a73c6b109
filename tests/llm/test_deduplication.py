from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm.components import connected_components
from lamina.llm.exact import blocks_for, drop_exact_copies, exact_copies
from lamina.llm.jaccard import _batches, keep_one_of_similar, similar_documents, set_ids
from lamina.llm.substrings import repeated_words
from lamina.llm.suffixes import ENTRY, _one_of_each, contexts, repeated_bytes, repeated_strings
from lamina.llm.words import SLICE_BYTES, slices
from tests.llm import fixtures as fx

ROWS = fx.corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return fx.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], fx.SCHEMA)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a string, b string")).isEmpty()


def test_exact_copies(spark, docs, empty):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    out = exact_copies(docs)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == want
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values())
    assert exact_copies(empty).isEmpty() and drop_exact_copies(empty).isEmpty()
    odd = spark.createDataFrame([(None, "q"), (4, "q"), (4, "q"), (5, "q"), (None, "z"), (None, "z")], "doc_id long, text string")
    rows = exact_copies(odd).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in rows) == [
        (0, 0, 2, False), (0, 0, 2, True), (0, 4, 4, False), (4, 4, 4, False), (4, 4, 4, True), (5, 4, 4, False)
    ]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in drop_exact_copies(odd).collect()) == [(0, "z"), (4, "q")]
    assert blocks_for(0) == 1 and blocks_for(10**12) == 1 << 15


def test_similar_documents(spark, docs, empty):
    rows = [r for r in ROWS]
    want = fx.components(rows)
    got = {r["doc_id"]: r for r in similar_documents(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(fx.shingle_set(t)) for i, t in rows}
    kept = keep_one_of_similar(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in rows if want[i] == i or not fx.shingle_set(t)}
    assert similar_documents(empty).isEmpty() and keep_one_of_similar(empty).isEmpty()
    text = "a b c d e f g"
    odd = spark.createDataFrame([(None, text), (9, text), (9, text), (3, None), (None, None), (8, text + " h")], "doc_id long, text string")
    assert sorted(((r["doc_id"] or 0, r["component_id"] or 0) for r in similar_documents(odd).collect())) == [(0, 0), (0, 8), (3, 3), (8, 8), (9, 8), (9, 8)]


def test_repeated_words(spark, docs, empty):
    want = fx.repeated_words(ROWS)
    got = {r["doc_id"]: r for r in repeated_words(docs).collect()}
    for i, t in ROWS:
        text = " ".join(want[i])
        n = len(fx.words_of(t))
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (n, n - len(want[i]), text)
        assert got[i]["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert repeated_words(empty).isEmpty()
    text = " ".join(f"v{i}" for i in range(30))
    odd = spark.createDataFrame([(None, text), (2, text), (2, text), (1, "x " + text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeated_words(odd).collect()) == [(0, 30), (1, 0), (2, 30), (2, 30)]


def test_repeated_bytes(spark, docs, empty):
    want = fx.repeated_bytes(ROWS)
    got = {r["doc_id"]: r for r in repeated_bytes(docs).collect()}
    for i, t in ROWS:
        n = len((t or "").encode())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (n, n - len(want[i][1]), *want[i])
    assert repeated_bytes(empty).isEmpty()
    text = "".join(f"v{i}," for i in range(200))
    odd = spark.createDataFrame([(1, text), (1, text), (None, "y" + text[:450]), (None, None)], "doc_id long, text string")
    cut = text.encode()[:450]
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["n_spans"]) for r in repeated_bytes(odd).collect()) == [(0, 0, 0), (0, len(cut), 1), (1, len(cut), 1), (1, len(cut), 1)]


def test_a_repeated_row_meets_its_neighbour_in_one_batch_only(spark):
    """Whatever comes first in the shuffle: the copy that was parsed beside the neighbour, or the ones that were not."""
    shared = "".join(f"v{i}," for i in range(1500))[:3000]
    row, neighbour = (1, 7, "a" * 50 + shared), (2, 8, "b" * 60 + shared)
    for order in ([row], [row, neighbour], [row]), ([row], [row], [row, neighbour]), ([row, neighbour], [row], [row]):
        parts = spark.sparkContext.parallelize(order, 3).flatMap(lambda x: x)
        rows = spark.createDataFrame(parts, "doc long, crc long, text string")
        found = {r["doc"]: np.frombuffer(r["ranges"], "<i8").tolist() for r in repeated_strings(rows, contexts(rows, 256), 256).collect()}
        assert found == {1: [50, 3050], 2: [60, 3060]}


@pytest.mark.parametrize("known", [(0, 1), (1, 0), (0, 0)])
def test_of_repeated_entries_the_known_one_stays(known):
    entry = np.zeros(3, ENTRY)
    entry["core"], entry["doc"], entry["known"] = 5, [1, 1, 2], [*known, 0]
    assert _one_of_each(entry)[["doc", "known"]].tolist() == [(1, max(known)), (2, 0)]


def test_one_group_of_a_third_of_all_rows(spark):
    """A popular text and its near copies do not change what is found."""
    base = " ".join(f"h{i}" for i in range(60))
    rows = [(i, base) for i in range(40)] + [(100 + i, f"{base} t{i}") for i in range(30)] + [(200 + i, " ".join(f"u{i}x{k}" for k in range(30))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert exact_copies(docs).where("kept").count() == 81
    parts = similar_documents(docs).groupBy("component_id").agg(F.count("*").alias("n")).collect()
    assert sorted((r["component_id"], r["n"]) for r in parts if r["n"] > 1) == [(0, 70)]
    assert repeated_words(docs).agg(F.sum("n_removed")).first()[0] == 39 * 60 + 30 * 60


def test_a_task_works_on_bounded_text():
    texts = [" ".join(f"w{i}x{k}" for k in range(20_000)) for i in range(30)] + [None, "", "a few words", "x" * (2 * SLICE_BYTES), "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    seen = [(ids, set_ids(s, at).tolist(), sum(len(t or "") for t in part.column(1).to_pylist())) for ids, s, at, part in _batches([batch.slice(2)])]
    assert [i for ids, _, _ in seen for i in ids] == list(range(2, len(texts)))
    assert all(size <= SLICE_BYTES or len(ids) == 1 for ids, _, size in seen)
    alone = [set_ids(s, at)[0] for i in range(2, len(texts)) for _, s, at, _ in _batches([batch.slice(i, 1)])]
    assert [n for _, names, _ in seen for n in names] == alone
    assert [p.num_rows for p in slices(pa.RecordBatch.from_arrays([pa.array(["a"] * 2_500)], ["text"]), 0)] == [1_000, 1_000, 500]
    assert not list(slices(batch.slice(0, 0), 1))
