from __future__ import annotations

import random
import re

import corpus_pipeline
from lamina.llm.queries import QUERIES, tokenizer_path
from tests.llm import fixtures as fx


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rng = random.Random(77)
    rows = [(i, t) for i, t in fx.corpus(8) if t is None or len(t) < 4000]
    items = [(k, fx.sentence(rng, 25)) for k in range(3)]
    start = max(i for i, _ in rows) + 1
    rows += [(start + k, f"{fx.sentence(rng, 30)} {text} {fx.sentence(rng, 10)}") for k, text in items]
    fx.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {i: t for i, t in rows if re.search(r"[^\W\d_]", t or "")}
    first: dict[str, int] = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    component = fx.components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if component[i] == i}
    kept = {i: t for i, t in kept.items() if i < start}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(kept)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    for i, t in kept.items():
        assert sum(r["length"] for r in out if r["doc_id"] == i) == len(tokenizer.encode(t, add_special_tokens=False).ids) + 1


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
