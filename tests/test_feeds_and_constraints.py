"""What a table guarantees: only clean versions are committed, and each load leaves its change feed."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lamina.contracts import ENTITIES
from lamina.operators import history as h
from lamina.operators import merge as m
from lamina.operators import quality as q
from lamina.operators.layout import cluster
from lamina.plans import jobs
from lamina.sources import snapshots as s
from lamina.sources.startables import READERS

T0 = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def day(n: int) -> dt.datetime:
    return T0 + dt.timedelta(days=n)


def frame(spark, rows, schema="id string, val string, n int"):
    return spark.createDataFrame(rows, schema)


def load(spark, base, rows, n, **options):
    merged = m.merge(s.read_snapshot(spark, base), rows, "id", images=True, **options)
    return s.write_snapshot(merged.actions, base, day(n), "merge")


def feed(df):
    return sorted((r["_commit_version"], r["id"], r["_change_type"], r["val"]) for r in df.collect())


def test_feed_of_loads_equals_the_joins_of_snapshots(spark, folder):
    loads = [[("1", "a", 1), ("2", "b", 2), ("3", None, 3)], [("2", "B", 2), ("4", "d", 4)], [("1", "x", 0), ("3", "c", 3), ("4", "d", 4)]]
    for n, rows in enumerate(loads):
        load(spark, folder, frame(spark, rows), n, delete_when="s.val = 'x'", update_when="NOT (s.val <=> t.val)")
    assert feed(s.read_changes(spark, folder, 2)) == [
        (2, "2", "update_postimage", "B"), (2, "2", "update_preimage", "b"), (2, "4", "insert", "d"),
        (3, "1", "delete", "a"), (3, "3", "update_postimage", "c"), (3, "3", "update_preimage", None),
    ]
    for version in (2, 3):
        old, new = (s.read_snapshot(spark, folder, v) for v in (version - 1, version))
        joined = h.changes_between(old, new, "id").withColumn("_commit_version", F.lit(version))
        assert feed(joined) == feed(s.read_changes(spark, folder, version, version))
    assert s.read_changes(spark, folder, 1, 1).select("_commit_timestamp").distinct().first()[0] == day(0)
    assert s.read_snapshot(spark, folder).columns == ["id", "val", "n"]
    assert {r["id"]: r["val"] for r in s.read_snapshot(spark, folder).collect()} == {"2": "B", "3": "c", "4": "d"}


def test_feed_reads_only_changed_rows(spark, folder):
    load(spark, folder, frame(spark, [(str(i), "a", i) for i in range(500)]), 0)
    load(spark, folder, frame(spark, [("7", "b", 7)]), 1)
    changed = s.read_changes(spark, folder, 2)
    assert feed(changed) == [(2, "7", "update_postimage", "b"), (2, "7", "update_preimage", "a")]
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_action" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_feed_through_new_columns_rewrites_and_refusals(spark, folder):
    load(spark, folder, frame(spark, [("1", "a", 1)]), 0)
    load(spark, folder, spark.createDataFrame([("1", "b", 1, "new")], "id string, val string, n int, extra string"), 1)
    both = s.read_changes(spark, folder, 1)
    assert "extra" in both.columns and {(r["_change_type"], r["val"], r["extra"]) for r in both.where("_commit_version = 2").collect()} == {
        ("update_preimage", "a", None), ("update_postimage", "b", "new"),
    }
    s.write_snapshot(cluster(s.read_snapshot(spark, folder), ["id"], 1), folder, day(2), "cluster")
    load(spark, folder, frame(spark, [("2", "z", 2)]), 3)
    assert feed(s.read_changes(spark, folder, 3)) == [(4, "2", "insert", "z")]
    s.write_snapshot(frame(spark, [("9", "q", 9)]), folder, day(4))
    with pytest.raises(ValueError, match="without a change feed: 5"):
        s.read_changes(spark, folder, 1)
    for first, last in ((9, None), (3, 3)):
        with pytest.raises(ValueError):
            s.read_changes(spark, folder, first, last)


def test_violating_load_leaves_the_old_version(spark, folder):
    s.write_snapshot(frame(spark, [("1", "a", 1), ("2", "b", None)]), folder, day(0))
    s.add_constraints(spark, folder, {"n_positive": "n > 0"}, ["id"])
    for rows, names in (
        ([("1", "a", -1)], "n_positive: 1 rows"),
        ([("1", "a", 1), ("1", "b", 1)], "unique_id: 2 rows"),
        ([(None, "a", 1), ("5", "a", -2)], "n_positive: 1 rows; not_null_id: 1 rows"),
    ):
        with pytest.raises(q.ConstraintViolated, match=names):
            s.write_snapshot(frame(spark, rows), folder, day(1))
        assert s.last_version(spark, folder) == 1 and s.read_snapshot(spark, folder).count() == 2
    assert s.write_snapshot(frame(spark, [("3", "c", 3)]), folder, day(1))["version"] == 2
    with pytest.raises(q.ConstraintViolated, match="val_known"):
        s.write_snapshot(frame(spark, [("3", "?", 3)]), folder, day(2), checks=q.business_rule("val_known", "known", F.col("val") == "?"))
    # What a merge deletes need not meet the constraints any more.
    merged = m.merge(s.read_snapshot(spark, folder), frame(spark, [("3", "c", -9)]), "id", delete_when="s.n < 0", images=True)
    assert s.write_snapshot(merged.actions, folder, day(3), "merge")["deleted"] == 1


def test_constraints_are_checked_when_they_are_added(spark, folder):
    s.write_snapshot(frame(spark, [("1", "a", -1), ("1", "b", 1)]), folder, day(0))
    with pytest.raises(q.ConstraintViolated, match="n_positive: 1 rows"):
        s.add_constraints(spark, folder, {"n_positive": "n > 0"})
    with pytest.raises(q.ConstraintViolated, match="unique_id: 2 rows"):
        s.add_constraints(spark, folder, {}, ["id"])
    assert s.table_constraints(spark, folder) == []
    s.add_constraints(spark, folder, {"val_there": "val IS NOT NULL"}, ["val"])
    for again in ({"val_there": "true"}, {}):
        with pytest.raises(ValueError, match="already"):
            s.add_constraints(spark, folder, again, ["n"])
    assert [r.name for r in s.table_constraints(spark, folder)] == ["val_there", "not_null_val", "unique_val"]


def test_constraints_of_a_history_hold_for_its_current_rows(spark, folder):
    rows = frame(spark, [("1", "a", 1)])
    s.write_history(h.open_versions(rows, day(0)), folder, day(0))
    s.add_constraints(spark, folder, {"n_positive": "n > 0"}, ["id"])
    for value, n in (("b", 1), ("c", -1)):
        step = h.advance(s.read_history(spark, folder), frame(spark, [("1", value, n)]), "id", ["val"], day(1))
        if n > 0:
            s.write_history(step, folder, day(1))
        else:
            with pytest.raises(q.ConstraintViolated):
                s.write_history(step, folder, day(2))
    assert s.last_version(spark, folder) == 2 and s.read_history(spark, folder).where("IsCurrent").first()["val"] == "b"


def test_jobs_keep_a_feed_and_meet_constraints(spark, folder):
    lake = jobs.Lake(folder)
    for name, read in READERS.items():
        options = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}
        read(spark, SF).write.options(**options).csv(lake.path("landing", name))
    first = jobs.Run("run1", T0, feed=True)
    jobs.bronze_job(spark, lake, first)
    jobs.silver_job(spark, lake, first)
    doctors = lake.path("silver", "doctors")
    s.add_constraints(spark, doctors, {"experience_sane": "Experience < 90"}, ["DoctorID"])
    one = jobs.read_silver(spark, lake, "doctors").orderBy("DoctorID").first()
    changed = READERS["doctors"](spark, SF).where(F.col("DoctorID") == one["DoctorID"])
    for k, years in enumerate((41, 120)):
        changed.withColumn("Experience", F.lit(years)).write.mode("append").option("header", "true").csv(lake.path("landing", "doctors"))
        run = jobs.Run(f"next{k}", day(1 + k), feed=True)
        jobs.bronze_job(spark, lake, run, entities=["doctors"])
        if years < 90:
            jobs.silver_job(spark, lake, run, since=day(1 + k).date())
        else:
            with pytest.raises(q.ConstraintViolated, match="experience_sane"):
                jobs.silver_job(spark, lake, run, since=day(1 + k).date())
    changes = s.read_changes(spark, doctors, 2).collect()
    assert [(r["_change_type"], r["DoctorID"], r["Experience"]) for r in changes] == [
        ("update_preimage", one["DoctorID"], one["Experience"]), ("update_postimage", one["DoctorID"], 41),
    ]
    assert jobs.register_all(spark, lake)["silver.doctors"] == "SUCCESS"
    assert set(spark.table("doctors").columns) == set(ENTITIES["doctors"].columns)
    assert spark.sql(f"SELECT Experience FROM doctors WHERE DoctorID = '{one['DoctorID']}'").first()[0] == 41
