from __future__ import annotations

import random

from pyspark.sql import functions as F

from lamina.functions.sketches import merged_quantiles, quantile_sketches, rank_error, rank_span
from lamina.operators.layout import SAMPLE_ROWS, files_for, range_splits


def test_merged_sketches_keep_their_rank_error(spark, folder):
    rng = random.Random(2)
    rows = [(i % 30, i % 3, rng.lognormvariate(5, 2) if i % 11 else None) for i in range(30_000)]
    df = spark.createDataFrame(rows, "day int, kind int, v double").repartition(5)
    quantile_sketches(df, ["day"], "v", 512).write.parquet(f"{folder}/days")
    days = spark.read.parquet(f"{folder}/days")
    assert days.count() == 30 and days.agg(F.sum("Rows")).first()[0] == sum(r[2] is not None for r in rows)
    values = sorted(r[2] for r in rows if r[2] is not None)
    for part, keep in ((days, lambda d: True), (days.where("day < 7"), lambda d: d < 7)):
        own = sorted(r[2] for r in rows if r[2] is not None and keep(r[0]))
        found = merged_quantiles(part, [0.1, 0.5, 0.99], k=512).first()["Quantiles"]
        for rank, value in zip((0.1, 0.5, 0.99), found, strict=True):
            assert abs(sum(v <= value for v in own) / len(own) - rank) <= 3 * rank_error(512) + 1 / len(own)
    below, upto = df.agg(*rank_span("v", F.lit(values[len(values) // 2]))).first()
    assert below < 0.5 + 1e-3 and upto > 0.5 - 1e-3 and upto > below
    assert merged_quantiles(days, [0.5], ["day"]).count() == 30
    assert quantile_sketches(df.limit(0), ["day"], "v").isEmpty()


def test_borders_of_all_columns_from_one_sample(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"k{i:05d}", "same") for i in range(4000)], "n int, `s.x` string, one string")
    numbers, texts, same = range_splits(df, ["n", "s.x", "one"], 8)
    assert len(numbers) == 7 and all(abs(v - 500 * (k + 1)) < 5 for k, v in enumerate(numbers))
    assert len(texts) == 7 and texts == sorted(texts) and same == []
    assert range_splits(df.limit(0), ["n"], 8) == [[]] and SAMPLE_ROWS >= 10_000
    assert files_for(df, 10_000) > 4 and files_for(df.limit(0)) == 1
