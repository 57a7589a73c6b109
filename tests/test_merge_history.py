from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.operators import history as h
from lamina.operators import merge as m
from lamina.sources.snapshots import (
    read_history,
    read_snapshot,
    version_log,
    write_history,
    write_snapshot,
)

T0 = dt.datetime(2024, 1, 1)


def day(n: int) -> dt.datetime:
    return T0 + dt.timedelta(days=n)


def frame(spark, rows, schema="id string, val string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("small", [True, False])
def test_upsert(spark, small, monkeypatch):
    monkeypatch.setattr(m, "fits_broadcast", lambda df: small)
    target = frame(spark, [("elm", "tall"), ("oak", "old"), ("fir", "green"), (None, "nameless")])
    source = frame(spark, [("fir", "blue"), ("oak", "older"), ("yew", "slow")])
    result = m.merge(target, source, "id")
    assert {r["id"]: r["val"] for r in result.snapshot.collect()} == {"elm": "tall", "oak": "older", "fir": "blue", "yew": "slow", None: "nameless"}
    assert {r["Action"]: r["Rows"] for r in result.counts().collect()} == {"kept": 2, "updated": 2, "inserted": 1}


@pytest.mark.parametrize("small", [True, False])
def test_merge_clauses(spark, small, monkeypatch):
    monkeypatch.setattr(m, "fits_broadcast", lambda df: small)
    target = frame(spark, [("1", "A"), ("2", "B"), ("3", "C")])
    source = frame(spark, [("1", "gone", 9), ("2", "B2", 8), ("4", "D", 7)], "id string, val string, extra int")
    result = m.merge(target, source, ["id"], delete_when="s.val = 'gone'", update_when="s.val <> t.val", insert=False)
    assert sorted(map(tuple, result.snapshot.collect())) == [("2", "B2", 8), ("3", "C", None)]
    renamed = m.merge(target, source, "id", update_set={"val": "concat(t.val, s.val)"}, match_also="t.val <> 'A'")
    assert sorted(map(tuple, renamed.snapshot.collect()), key=repr) == sorted(
        [("1", "A", None), ("1", "gone", 9), ("2", "BB2", None), ("3", "C", None), ("4", "D", 7)], key=repr
    )


def test_source_keys_must_be_present_and_unique(spark):
    target = frame(spark, [("1", "A")])
    with pytest.raises(m.MergeKeyError, match="not unique"):
        m.merge(target, frame(spark, [("1", "x"), ("1", "y")]), "id")
    with pytest.raises(m.MergeKeyError, match="no value"):
        m.merge(target, frame(spark, [(None, "x")]), "id")


def test_type_one_updates_only_on_change(spark):
    target = frame(spark, [("1", "A", 1), ("2", None, 2)], "id string, val string, other int")
    source = frame(spark, [("1", "A", 10), ("2", "B", 20), ("3", "C", 30)], "id string, val string, other int")
    rows = sorted(map(tuple, m.merge_changed(target, source, "id", ["val"]).snapshot.collect()))
    assert rows == [("1", "A", 1), ("2", "B", 20), ("3", "C", 30)]


def test_late_rows_do_not_replace_newer_ones(spark):
    schema = "id string, val string, at timestamp"
    held = frame(spark, [("1", "A", day(5)), ("2", "B", None), ("3", "C", day(5)), ("4", "D", day(5))], schema)
    sent = frame(spark, [("1", "old", day(1)), ("2", "b", day(1)), ("3", "c", day(6)), ("4", "none", None)], schema)
    rows = {r["id"]: r["val"] for r in m.merge_changed(held, sent, "id", ["val"], "at").snapshot.collect()}
    assert rows == {"1": "A", "2": "b", "3": "c", "4": "D"}
    whole = {r["id"]: r["val"] for r in m.merge_changed(held, sent, "id", None, "at").snapshot.collect()}
    assert whole == rows
    state = h.apply_history(None, held, "id", ["val"], day(7))
    step = h.filter_current(h.advance(state, sent, "id", ["val"], day(8), newest_by="at"))
    assert {r["id"]: r["val"] for r in step.collect()} == rows


def test_type_two_versions(spark):
    first = h.apply_history(None, frame(spark, [("1", "A")]), "id", ["val"], day(0))
    second = h.apply_history(first, frame(spark, [("1", "B"), ("2", "C")]), "id", ["val"], day(1))
    rows = {(r["id"], r["VersionNumber"]): r for r in second.collect()}
    assert set(rows) == {("1", 1), ("1", 2), ("2", 1)}
    assert rows[("1", 1)]["EffectiveEndDate"] == day(1) and not rows[("1", 1)]["IsCurrent"]
    assert rows[("1", 2)]["val"] == "B" and rows[("1", 2)]["IsCurrent"]
    assert h.filter_current(second).count() == 2


def test_returning_key_goes_on_numbering(spark):
    state = h.apply_history(None, frame(spark, [("1", "A"), ("2", "X")]), "id", ["val"], day(0))
    state = h.apply_history(state, frame(spark, [("2", "X")]), "id", ["val"], day(1), close_missing=True)
    state = h.apply_history(state, frame(spark, [("1", "A"), ("2", "X")]), "id", ["val"], day(2))
    got = sorted((r["id"], r["VersionNumber"], r["IsCurrent"]) for r in state.collect())
    assert got == [("1", 1, False), ("1", 2, True), ("2", 1, True)]


def test_new_columns_join_the_history(spark):
    state = h.apply_history(None, frame(spark, [("1", "A")]), "id", ["val"], day(0))
    wider = frame(spark, [("1", "A", "n")], "id string, val string, note string")
    state = h.apply_history(state, wider, "id", ["val", "note"], day(1))
    assert sorted((r["VersionNumber"], r["note"]) for r in state.collect()) == [(1, None), (2, "n")]


def test_current_flag_in_any_form(spark):
    df = frame(spark, [("true",), ("True",), ("1",), ("yes",), ("Y",), ("no",), ("0",), (None,)], "IsCurrent string")
    assert [r["IsCurrent"] for r in h.filter_current(df).collect()] == ["true", "True", "1", "yes", "Y"]
    assert h.filter_current(df.withColumnRenamed("IsCurrent", "x")).count() == 0
    assert h.filter_current(spark.createDataFrame([(1,), (0,)], "IsCurrent int")).count() == 1


states = st.dictionaries(st.sampled_from("abc"), st.sampled_from(["x", "y", None]), min_size=1, max_size=3)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(loads=st.lists(states, min_size=1, max_size=4), close=st.booleans())
def test_history_properties(spark, loads, close):
    """One current row per key at most, versions 1..n, intervals in order, and reapplying changes nothing."""
    state = None
    for n, load in enumerate(loads):
        source = frame(spark, sorted(load.items()))
        state = h.apply_history(state, source, "id", ["val"], day(n), close_missing=close)
    kept = [r.asDict() for r in state.collect()]
    again = h.apply_history(state, frame(spark, sorted(loads[-1].items())), "id", ["val"], day(99), close_missing=close)
    assert sorted(map(repr, kept)) == sorted(repr(r.asDict()) for r in again.select(*state.columns).collect())
    for key in {r["id"] for r in kept}:
        rows = sorted((r for r in kept if r["id"] == key), key=lambda r: r["VersionNumber"])
        assert [r["VersionNumber"] for r in rows] == list(range(1, len(rows) + 1))
        assert sum(r["IsCurrent"] for r in rows) <= 1
        for before, after in zip(rows, rows[1:], strict=False):
            end = before["EffectiveEndDate"]
            assert end is not None and end <= after["EffectiveStartDate"] and before["EffectiveStartDate"] < end
            if not close:
                assert end == after["EffectiveStartDate"]
    present = {r["id"]: r["val"] for r in kept if r["IsCurrent"]}
    for key, value in loads[-1].items():
        assert present[key] == value


changes = st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.integers(0, 40)), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(log=changes, most=st.sampled_from([1000, 3, 2]))
def test_chunked_log_equals_brute_force(spark, log, most):
    rows = [(k, v, T0 + dt.timedelta(hours=7 * t), i) for i, (k, v, t) in enumerate(log)]
    df = spark.createDataFrame(rows, "id string, val string, at timestamp, seq int")
    got = sorted(tuple(r) for r in h.history_from_log(df, "id", ["val"], "at", "seq", max_rows=most).select(
        "id", "val", "EffectiveStartDate", F.coalesce("EffectiveEndDate", F.lit(dt.datetime(9999, 1, 1))), "VersionNumber").collect())
    want = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[3]))
        kept = [r for i, r in enumerate(mine) if i == 0 or r[1] != mine[i - 1][1]]
        for i, r in enumerate(kept):
            end = kept[i + 1][2] if i + 1 < len(kept) else dt.datetime(9999, 1, 1)
            want.append((key, r[1], r[2], end, i + 1))
    assert got == sorted(want)


def test_log_replayed_load_by_load_gives_the_same_history(spark):
    log = [("a", "x", 0), ("b", "x", 0), ("a", "y", 1), ("b", "x", 1), ("a", "x", 2), ("b", "z", 2)]
    df = spark.createDataFrame([(k, v, day(n), i) for i, (k, v, n) in enumerate(log)], "id string, val string, at timestamp, seq int")
    direct = h.history_from_log(df, "id", ["val"], "at", "seq")
    state = None
    for n in range(3):
        load = frame(spark, [(k, v) for k, v, at in log if at == n])
        state = h.apply_history(state, load, "id", ["val"], day(n))
    assert sorted(map(repr, state.select(*direct.columns).collect())) == sorted(map(repr, direct.collect()))


def test_one_key_with_most_of_a_log(spark):
    """No window holds more than ``max_rows`` rows of any key, and the summaries are merged over several levels."""
    rng = random.Random(4)
    rows = [("hot" if i % 10 else f"cold{i % 70}", rng.choice("ab"), i) for i in range(2000)]
    df = spark.createDataFrame([(k, v, day(0) + dt.timedelta(seconds=n // 3), n) for k, v, n in rows], "id string, val string, at timestamp, seq int")
    placed = h.in_ranges(df, ["id"], ["at", "seq"], 9)
    per_task = placed.groupBy("id", "_chunk").count()
    assert per_task.agg(F.max("count")).first()[0] <= 9 and per_task.where("id = 'hot'").count() > 9 * 9
    direct, cut = (sorted(map(repr, h.history_from_log(df, "id", ["val"], "at", "seq", n).collect())) for n in (5000, 9))
    assert direct == cut and len(direct) > 800
    bounded = [w for w in re.findall(r"windowspecdefinition\(([^)]*)\)", plan_of(h.history_from_log(df, "id", ["val"], "at", "seq", 9)))]
    assert bounded and all("_chunk" in w for w in bounded)


def test_ranges_of_a_log_are_no_more_files_than_the_session_shuffles_into(spark):
    """Ranges of two rows, and rows that are equal in the order, as well."""
    df = spark.range(3000).selectExpr("id % 3 AS id", "string(id % 7) AS val", "timestamp_seconds(least(id, 1000)) AS at", "int(least(id, 1000)) AS seq")
    placed = h.in_ranges(df, ["id"], ["at", "seq"], 2)
    assert len(placed.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert placed.count() == 3000 and placed.groupBy("_chunk").count().agg(F.max("count")).first()[0] == 2


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_valid_at_and_changes_between(spark):
    one, two = frame(spark, [("1", "A"), ("2", "B"), ("4", None)]), frame(spark, [("1", "A2"), ("3", "C"), ("4", None)])
    feed = sorted(map(tuple, h.changes_between(one, two, "id").collect()))
    assert feed == [("1", "A", "update_preimage"), ("1", "A2", "update_postimage"), ("2", "B", "delete"), ("3", "C", "insert")]
    state = h.apply_history(h.apply_history(None, one, "id", ["val"], day(0)), two, "id", ["val"], day(5))
    assert {r["id"]: r["val"] for r in h.valid_at(state, day(1)).collect()} == {"1": "A", "2": "B", "4": None}
    assert {r["id"]: r["val"] for r in h.valid_at(state, day(5)).collect()} == {"1": "A2", "2": "B", "3": "C", "4": None}


def test_snapshots_and_log(spark, folder):
    one, two = frame(spark, [("1", "A"), ("2", "B")]), frame(spark, [("2", "B2"), ("3", "C")])
    write_snapshot(one, folder, day(0))
    done = write_snapshot(m.merge(read_snapshot(spark, folder), two, "id").actions, folder, day(1), "merge")
    assert (done["version"], done["rows"], done["inserted"], done["updated"]) == (2, 3, 1, 1)
    assert read_snapshot(spark, folder).count() == 3
    assert read_snapshot(spark, folder, version=1).count() == 2
    assert read_snapshot(spark, folder, at=day(0)).count() == 2
    assert [r["operation"] for r in version_log(spark, folder).collect()] == ["merge", "write"]


def test_uncommitted_snapshot_is_invisible_and_replaced(spark, folder):
    write_snapshot(frame(spark, [("1", "A")]), folder, day(0))
    frame(spark, [("9", "half written")]).write.parquet(f"{folder}/version=2")
    assert [r["id"] for r in read_snapshot(spark, folder).collect()] == ["1"]
    write_snapshot(frame(spark, [("2", "B")]), folder, day(1))
    assert [r["id"] for r in read_snapshot(spark, folder).collect()] == ["2"]


def test_history_table_reads_back_at_any_version(spark, folder):
    first = h.apply_history(None, frame(spark, [("1", "A"), ("2", "B")]), "id", ["val"], day(0))
    write_history(first, folder, day(0))
    step = h.advance(read_history(spark, folder), frame(spark, [("1", "A2"), ("3", "C")]), "id", ["val"], day(1))
    done = write_history(step, folder, day(1))
    assert (done["rows"], done["inserted"], done["updated"]) == (3, 1, 1)
    step = h.advance(read_history(spark, folder), frame(spark, [("1", "A3")]), "id", ["val"], day(2))
    write_history(step, folder, day(2))
    now = sorted((r["id"], r["val"], r["VersionNumber"], r["IsCurrent"]) for r in read_history(spark, folder).collect())
    assert now == [("1", "A", 1, False), ("1", "A2", 2, False), ("1", "A3", 3, True), ("2", "B", 1, True), ("3", "C", 1, True)]
    before = sorted((r["id"], r["val"], r["IsCurrent"]) for r in read_history(spark, folder, version=2).collect())
    assert before == [("1", "A", False), ("1", "A2", True), ("2", "B", True), ("3", "C", True)]


@pytest.mark.parametrize("kind", ["int", "decimal(10,2)", "date", "timestamp", "double"])
@pytest.mark.parametrize("keyed", [True, False])
def test_spans_meet_the_points_within_them(spark, kind, keyed):
    rng = random.Random(6)
    turn = (lambda n: day(n).date()) if kind == "date" else day if kind == "timestamp" else (lambda n: n)
    points = [(i, rng.choice("ab"), rng.choice([None, rng.randrange(-300, 300)])) for i in range(200)]
    spans = []
    for i in range(60):
        start = rng.randrange(-400, 400)
        spans.append((i, rng.choice("ab"), rng.choice([None, start, start, start]), rng.choice([None, start + rng.choice([-5, 0, 1, 3, 40, 700])])))
    value = lambda n: None if n is None else turn(n)
    base = "date" if kind == "date" else "timestamp" if kind == "timestamp" else "int"
    left = spark.createDataFrame([(i, k, value(n)) for i, k, n in points], f"_point long, k string, p {base}").withColumn("p", F.col("p").cast(kind))
    right = spark.createDataFrame([(i, k, value(a), value(b)) for i, k, a, b in spans], f"_span long, k string, a {base}, b {base}")
    right = right.withColumns({c: F.col(c).cast(kind) for c in "ab"})
    got = sorted(tuple(r) for r in m.interval_hits(left, right, "p", "a", "b", ["k"] if keyed else []).collect())
    assert got == sorted(
        (i, j) for i, k, n in points for j, q, a, b in spans if n is not None and (k == q or not keyed) and (a is None or n >= a) and (b is None or n < b)
    )
    assert "NestedLoop" not in m.interval_hits(left, right, "p", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert m.interval_hits(left.limit(0), right, "p", "a", "b").isEmpty() and m.interval_hits(left, right.limit(0), "p", "a", "b").isEmpty()


def test_merge_between_spans(spark):
    held = spark.createDataFrame([("x", 5, "old"), ("x", 50, "old"), ("y", 7, "old"), ("y", None, "old")], "k string, p int, val string")
    sent = spark.createDataFrame([("x", 0, 10, "new"), ("y", 7, 8, "gone"), ("x", 90, None, "added")], "k string, lo int, hi int, val string")
    done = m.merge_between(held, sent, "p", "lo", "hi", "k", delete_when="s.val = 'gone'", update_set={"val": "s.val"}, images=True)
    rows = {(r["k"], r["p"]): (r["val"], r["_action"], r["_before"] and r["_before"]["val"]) for r in done.actions.collect()}
    assert rows == {("x", 5): ("new", "updated", "old"), ("x", 50): ("old", "kept", None), ("y", 7): ("old", "deleted", None), ("y", None): ("old", "kept", None), ("x", None): ("added", "inserted", None)}
    with pytest.raises(m.MergeKeyError, match="1 target rows"):
        m.merge_between(held, sent.where("lo = 0").unionByName(sent.where("lo = 0")), "p", "lo", "hi", "k")
