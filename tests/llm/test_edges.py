"""Rows that repeat, clash, are very long or missing, for the operators whose main tests leave them out."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import language, pii
from lamina.llm.decontamination import contaminated, drop_contaminated
from lamina.llm.packed import KeyFilter, buckets_for, records, repeated_bits, short_keys
from lamina.llm.secret_scan import find_secrets
from lamina.llm.urls import Rule, filter_urls
from tests.llm import fixtures as fx

PAGES = "page_id long, url string, html string, node string, verdict string"


def twice(df):
    return df.unionByName(df)


def doubled(once, again) -> bool:
    """Whether the second frame has every row of the first just twice."""
    rows = Counter(map(repr, once.collect()))
    return Counter(map(repr, again.collect())) == Counter({r: 2 * n for r, n in rows.items()}) and bool(rows)


def test_repeated_pages_long_addresses_and_rules_of_equal_length(spark):
    long = "http://a.com/" + "x/" * 200_000
    link = '<link rel="canonical" href="http://bad.org/q">'
    rows = [(1, long, None), (2, "http://b.com/en/1", link), (None, "http://c.io/", link), (4, None, None), (5, "http://a.b.net/x/1", "<p>" * 100_000)]
    pages = spark.createDataFrame([(*r, "n", "v") for r in rows], PAGES)
    rules = (Rule("block", "bad.org", "/"), Rule("allow", "b.net", "/x/1"), Rule("block", "a.b.net", "/x"), Rule("block", "a.com", "/"))
    once = filter_urls(pages, rules)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in once.collect()}
    assert got[1] == ("a.com/", "block") and got[2][1] == got[None][1] == "block" and got[4] == (None, "allow")
    # b.net/x/1 and a.b.net/x are equally long: one of them, and always the same, decides.
    assert len({filter_urls(pages, rules).where("page_id = 5").first()["rule"] for _ in range(3)}) == 1
    assert doubled(once, filter_urls(twice(pages), rules)) and {r["path"] for r in once.where("page_id = 1").collect()} == {long[len("http://a.com") :]}


def test_repeated_secrets(spark):
    docs = fx.frame(spark, [(i, f'api_key = "k{i * 7919:08d}Zq9LmX{i:04d}"') for i in range(40)] + [(None, "password: abc123"), (77, None)])
    once = find_secrets(docs).select("doc_id", "start", "end", "masked")
    assert doubled(once, find_secrets(twice(docs)).select("doc_id", "start", "end", "masked"))


def test_repeated_and_clashing_languages(spark):
    rows = [(i, ("schein keit lich " if i % 2 else "tion ough the ") * (2 + i % 9), "de" if i % 2 else "en") for i in range(120)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clashing = plain.withColumns({"score": F.lit("s"), "lang_pred": F.lit("p"), "held_out": F.lit("h"), "features": F.lit(1), "rejected": F.lit("r")})
    columns = ["doc_id", "held_out", "lang_pred", "score"]
    once = language.identify_languages(clashing).select(*columns)
    assert Counter(map(repr, once.collect())) == Counter(map(repr, language.identify_languages(plain).select(*columns).collect()))
    again = {(r["doc_id"], r["lang_pred"]) for r in language.identify_languages(twice(clashing)).collect()}
    assert again == {(i, lang) for i, _, lang in rows}
    kept = language.keep_identified(clashing)
    assert kept.columns == clashing.columns and kept.count() == 120


def test_long_repeated_and_renamed_benchmark_items(spark):
    rng = random.Random(6)
    item, other = fx.sentence(rng, 30), fx.sentence(rng, 40)
    texts = [(1, f"{fx.sentence(rng, 60_000)} {item} {fx.sentence(rng, 20_000)}"), (2, other), (3, fx.sentence(rng, 50)), (None, item)]
    docs = fx.frame(spark, texts)
    bench = spark.createDataFrame([(7, item), (7, other), (7, item), (8, other), (None, "")], "item_id long, text string")
    once = contaminated(docs, bench)
    assert sorted((r["doc_id"] or 0, r["item_id"], r["start"], r["similarity"]) for r in once.collect()) == [(0, 7, 0, 1.0), (1, 7, 60_000, 1.0), (2, 7, 0, 1.0), (2, 8, 0, 1.0)]
    assert doubled(once, contaminated(twice(docs), bench))
    assert [r["doc_id"] for r in drop_contaminated(twice(docs), bench).collect()] == [3, 3]


def test_many_addresses_in_one_text_take_linear_time(spark):
    text = " ".join(f"user{i}@mail{i % 7}.example" for i in range(100_000))
    short = " ".join(f"u{i}@m.example" for i in range(2 * pii.FOLD + 1))
    docs = spark.createDataFrame([(1, text), (2, short)], "doc_id long, text string")
    started = time.perf_counter()
    rows = {r["doc_id"]: r["spans"] for r in docs.select("doc_id", pii.located(F.col("text"), pii.GENERATORS[0][1]).alias("spans")).collect()}
    assert time.perf_counter() - started < 60  # it took minutes for a fifth of them
    for i, t in ((1, text), (2, short)):
        assert all(t[s["start"] : s["end"]] == s["match"] for s in rows[i]) and len(rows[i]) == t.count("@")


def test_of_overlapping_proposals_the_best_score_stays(spark):
    spans = [(-0.9, "phone", 8, 20), (-0.7, "phone", 4, 20), (-0.7, "card", 20, 30), (-0.6, "card", 29, 40), (-0.7, "phone", 4, 7), (-0.5, "ip", 40, 44)]
    rows = [(s, a - b, (k, a, b, "m")) for s, k, a, b in spans]
    kind = "array<struct<less:double,shorter:int,s:struct<kind:string,start:int,end:int,match:string>>>"
    df = spark.createDataFrame([(rows,), ([],)], f"r {kind}").select(pii._best_apart(F.array_sort("r")).alias("kept"))
    assert [[(s["kind"], s["start"]) for s in r["kept"]] for r in df.collect()] == [[("phone", 8), ("card", 20), ("phone", 4), ("ip", 40)], []]


def test_repeated_personal_data(spark):
    docs = fx.frame(spark, [(i, f"mail a{i}@b.example and +49 30 12345{i:03d} " + "pad " * 2000) for i in range(30)] + [(None, None)])
    columns = ["doc_id", "n_email", "n_phone", "base_sha256"]
    assert doubled(pii.personal_data(docs).select(*columns), pii.personal_data(twice(docs)).select(*columns))


def test_a_key_of_very_many_rows_sends_two_from_a_batch():
    rng = np.random.default_rng(3)
    alone = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    hot, pair = np.uint64(0x1234567890ABCDEF), rng.integers(0, 1 << 63, 20).astype(np.uint64)
    buckets = buckets_for(1)
    batches = [short_keys(np.concatenate([np.full(100_000, hot), alone[:250], pair]), buckets), short_keys(np.concatenate([alone[250:], pair]), buckets)]
    import pyarrow as pa

    table = pa.Table.from_batches(batches)
    sent = sum(len(records(table.slice(i, 1), np.dtype("u1"), np.dtype("u1"))[0]) // 5 for i in range(table.num_rows))
    assert sent == 2 + 500 + 2 * len(pair)
    found, _ = repeated_bits(buckets)
    by_bucket = [found(table.filter(pa.compute.equal(table["bucket"], b))) for b in set(table["bucket"].to_pylist())]
    seen = KeyFilter((r for t in by_bucket for r in t.to_pylist()), buckets)
    assert hot in seen and seen.holds(pair).all() and seen.holds(alone).mean() < 0.01


def test_pipeline_of_nothing_and_of_repeated_rows(spark, tmp_path):
    rng = random.Random(5)
    spark.createDataFrame([(1, fx.sentence(rng, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    spark.createDataFrame([], fx.SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").isEmpty()
    rows = [(i, fx.sentence(rng, 60)) for i in range(6)] + [(None, fx.sentence(rng, 30)), (9, None)]
    fx.frame(spark, rows, repeat=4).write.parquet(f"{tmp_path}/twice/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/twice/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/twice").collect()
    assert Counter(r["doc_id"] for r in out) == Counter([0, 1, 2, 3, 4, 5, None])


def test_trees_of_personal_data_are_fitted_on_every_labelled_match(spark):
    """All of 90,000 labelled rows fit or calibrate, and as a few weighted rows."""
    span = F.struct(F.lit("phone").alias("kind"), F.lit("555").alias("match"), F.when(F.col("id") % 3 == 0, "part ").otherwise("call ").alias("before"), F.lit("").alias("after"))
    rows = spark.range(90_000).select(span.alias("span"), F.lit(True).alias("ok"), (F.col("id") % 3 != 0).cast("double").alias("label"), (F.col("id") / 90_000).alias("draw"))
    seen = []
    staged, pii.stage = pii.stage, lambda df, name: seen.append(staged(df, name)) or seen[-1]
    try:
        model, thresholds = pii.fit(rows)
    finally:
        pii.stage = staged
    assert seen[0].agg(F.sum("n")).first()[0] == 90_000 and seen[0].count() == 4
    assert model is not None and set(thresholds) == {"phone"}
