"""What the classifiers of op2 and op6 learn: precision and recall on findings that no label was given for."""

from __future__ import annotations

import random
import string

from pyspark.sql import functions as F

from lamina.llm import pii
from lamina.llm.secret_scan import candidates, coverage, dictionary, find_secrets, seed_labels
from lamina.llm.staging import doc_text
from tests.llm import fixtures as fx


def measured(found: set, true: set) -> tuple[float, float]:
    """(precision, recall)"""
    return len(found & true) / max(1, len(found)), len(found & true) / len(true)


def test_dictionary_has_words_of_any_length(spark):
    texts = ["Authentication of the configuration (straße), \"configuration\" is the: x1 ab http://the.org/the"] * 3 + ["once", None]
    words = dictionary(doc_text(fx.frame(spark, list(enumerate(texts)))))
    assert words == {"authentication", "the", "configuration", "straße"}
    assert coverage("configuration-authenticationX9", words) == 27 / 30
    assert coverage("", words) == 0 and coverage("the", frozenset()) == 0
    assert dictionary(doc_text(fx.frame(spark, [(1, None)]))) == frozenset()


def test_secrets_that_the_seed_rule_leaves_open(spark):
    rng = random.Random(4)
    words = ["report", "summary", "version", "customer", "invoice", "monthly", "account", "archive", "final", "draft"]
    key = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))
    name = lambda: "_".join(rng.choice(words) for _ in range(4)) + f"_{rng.randrange(2000, 2030)}"
    texts = [f"the monthly report of the customer: {w} and the final draft" for w in words] * 3
    texts += [f'we set api_key = "{key()}" in the file' for _ in range(80)] + [f"see the {name()} for the account" for _ in range(80)]
    first = len(texts)
    texts += [f"then use {key()} for the archive" for _ in range(60)] + [f'the file = "{name()}" is a draft' for _ in range(60)]
    docs = fx.frame(spark, list(enumerate(texts)))
    rows = doc_text(docs)
    seeds = seed_labels(candidates(rows, dictionary(rows))).where(F.col("doc_id") >= first)
    still_open = {r["doc_id"] for r in seeds.where("label is null").collect()}
    assert len(still_open & set(range(first, first + 60))) > 50 and len(still_open & set(range(first + 60, first + 120))) > 50
    found = {r["doc_id"] for r in find_secrets(docs).where("is_secret").collect()} & still_open
    precision, recall = measured(found, still_open & set(range(first, first + 60)))
    assert precision >= 0.95 and recall >= 0.95, (precision, recall)


def test_judged_proposals_teach_which_to_add(spark):
    """National numbers, which no base pattern matches: judged ones in even documents, measured in odd ones."""
    rng = random.Random(6)
    texts, truth = [], {}
    for i in range(800):
        number = f"{rng.randrange(200, 999)} {rng.randrange(200, 999)} {rng.randrange(1000, 9999)}"
        good = rng.random() < 0.5
        before = f"{rng.choice(['please call', 'her phone', 'mobile', 'tel'] if good else ['order', 'serial', 'the item', 'see model'])} "
        truth[i] = (good, len(before), len(before) + len(number))
        texts.append(f"{before}{number} today")
    docs = fx.frame(spark, list(enumerate(texts)))
    schema = "doc_id long, kind string, start int, end int, label int"
    labels = spark.createDataFrame([(i, "phone", a, b, int(g)) for i, (g, a, b) in truth.items() if i % 2 == 0], schema)
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs, labels=labels).collect()}
    found = {i for i, s in got.items() if i % 2 and s == f"phone:{truth[i][1]}:{truth[i][2]}"}
    precision, recall = measured(found, {i for i, (g, _, _) in truth.items() if i % 2 and g})
    assert precision >= 0.95 and recall >= 0.95 and all(got[i] == "" for i in got if i % 2 and i not in found), (precision, recall)
    assert set(r["spans"] for r in pii.personal_data(docs).collect()) == {""}  # no base match, nothing to learn from
    odd = labels.limit(1).unionByName(spark.createDataFrame([(0, "phone", 0, 3, 1), (None, None, None, None, None)], schema))
    assert set(r["spans"] for r in pii.personal_data(docs, labels=odd).collect()) == {""}
    both = labels.unionByName(labels.withColumn("label", F.lit(0)))
    assert set(r["spans"] for r in pii.personal_data(docs, labels=both).collect()) == {""}  # contradicting labels: the lowest
