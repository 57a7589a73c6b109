from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lamina.contracts import ENTITIES
from lamina.operators.cleaning import drop_lineage
from lamina.sources import landing, tables
from lamina.streaming.files import ingest, stream_landing, write_batch

AT = dt.datetime(2025, 6, 30)
DOCTORS = ENTITIES["doctors"]
HEAD = "DoctorID,DoctorName,Specialization,Department,Hospital,Experience"


def put(folder, name, *lines):
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path.parent)


def test_csv_rows_that_do_not_fit_are_rescued(spark, folder):
    path = put(
        folder,
        "in/a.csv",
        HEAD,
        "D1,Ann,s,d,h,5",
        "D2,Bob,s,d,h,many",
        "D3,Cid,s,d",
        "D4,Dee,s,d,h,4,surplus",
    )
    df = landing.scan_csv(spark, path, DOCTORS)
    assert {r["DoctorID"] for r in landing.rescued_rows(df).select("DoctorID", "_rescued_data").collect()} == {"D2", "D3", "D4"}
    good, bad = landing.split_bad_records(df)
    assert [r["DoctorID"] for r in good.select("DoctorID").collect()] == ["D1"]
    assert sorted(r["_rescued_data"] for r in bad.collect())[0] == "D2,Bob,s,d,h,many"
    assert df.first()["_source_file"].endswith("a.csv")


def test_csv_columns_are_matched_by_name(spark, folder):
    path = put(folder, "in/a.csv", "Hospital,DoctorID,Experience", "h1,D1,7")
    row = landing.scan_csv(spark, path, DOCTORS).first()
    assert (row["DoctorID"], row["Hospital"], row["Experience"], row["Department"]) == ("D1", "h1", 7, None)


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_evolution_modes(spark, folder, fmt):
    if fmt == "csv":
        path = put(folder, "in/a.csv", HEAD + ",Pager", "D1,Ann,s,d,h,5,P9")
    else:
        path = put(folder, "in/a.json", '[{"DoctorID": "D1", "Experience": 5, "Pager": "P9"}]')
    scan = lambda mode: landing.scan(spark, path, DOCTORS, fmt, evolution=mode)
    assert scan("addNewColumns").first()["Pager"] == "P9"
    assert "Pager" not in scan("none").columns
    assert scan("rescue").select("_rescued_data").first()[0] == '{"Pager":"P9"}'
    with pytest.raises(landing.NewColumnsFound, match="Pager"):
        scan("failOnNewColumns")


def test_json_array_and_lines(spark, folder):
    array = put(folder, "array/a.json", '[{"DoctorID": "D1", "Experience": 5}, {"DoctorID": "D2", "Experience": 6}]')
    lines = put(folder, "lines/a.json", '{"DoctorID": "D1", "Experience": 5}', '{"DoctorID": "D2", "Experience": "x"}', "{broken")
    assert landing.scan_json(spark, array, DOCTORS).select("DoctorID").count() == 2
    df = landing.scan_json(spark, lines, DOCTORS, multi_line=False)
    assert landing.rescued_rows(df).select("_rescued_data").count() == 2


def test_unknown_format(spark, folder):
    with pytest.raises(ValueError, match="unsupported"):
        landing.scan(spark, folder, DOCTORS, "xml")


def ingest_all(spark, folder, **options):
    ingest(
        spark, f"{folder}/in", DOCTORS, f"{folder}/bronze", f"{folder}/checkpoint", "LOAD1", lambda: AT, **options
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/bronze")


def test_stream_equals_batch_and_takes_each_file_once(spark, folder):
    for n in range(4):
        put(folder, f"in/{n}.csv", HEAD, f"D{n},Ann,s,d,h,{n}")
    streamed = ingest_all(spark, folder, files_per_trigger=1)
    batch = landing.scan_csv(spark, f"{folder}/in", DOCTORS)
    columns = list(DOCTORS.columns)
    assert sorted(map(tuple, streamed.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    assert streamed.select("_batch_id").distinct().count() == 4
    assert ingest_all(spark, folder).count() == 4
    put(folder, "in/late.csv", HEAD, "D9,Zoe,s,d,h,9")
    assert ingest_all(spark, folder).count() == 5
    assert all(r["_source_file"].endswith(".csv") for r in streamed.collect())


def test_json_stream_and_bad_records(spark, folder):
    put(folder, "in/a.json", '{"DoctorID": "D1", "Experience": 5}', '{"DoctorID": "D2", "Experience": "x"}')
    good = ingest_all(spark, folder, fmt="json", bad_target=f"{folder}/bad")
    assert [r["DoctorID"] for r in good.collect()] == ["D1"]
    assert spark.read.parquet(f"{folder}/bad").count() == 1


def test_replayed_batch_replaces_itself(spark, folder):
    from lamina.operators.lineage import add_lineage

    df = spark.createDataFrame([("D1", 1), ("D2", 2)], "DoctorID string, Experience int")
    for moment in (AT, AT + dt.timedelta(days=1)):
        write_batch(add_lineage(df, "L", "BATCH_doctors_0", moment), folder, "BATCH_doctors_0")
    out = spark.read.parquet(folder)
    assert out.count() == 2
    assert sorted(map(tuple, drop_lineage(out).collect())) == [("D1", 1), ("D2", 2)]
    assert {r["_batch_id"] for r in out.collect()} == {"BATCH_doctors_0"}


def test_tables_evolve_and_register(spark, folder):
    tables.write_table(spark.range(2).withColumn("p", F.lit("a")), f"{folder}/t", partition_by=["p"])
    tables.write_table(spark.range(2).select("id", F.lit(1).alias("extra"), F.lit("b").alias("p")), f"{folder}/t", partition_by=["p"])
    assert "extra" in tables.read_table(spark, f"{folder}/t", merge_schema=True).columns
    put(folder, "broken/x.parquet", "not parquet")
    report = tables.register_layer(spark, {"t": f"{folder}/t", "none": f"{folder}/none", "broken": f"{folder}/broken"})
    assert (report["t"], report["none"]) == ("SUCCESS", "SKIPPED") and report["broken"].startswith("FAILED")
    assert spark.sql("SELECT count(*) FROM t").first()[0] == 4


def test_register_in_a_database(spark, folder):
    tables.write_table(spark.range(3).withColumn("p", F.lit("a")), f"{folder}/t", partition_by=["p"])
    for _ in range(2):
        assert tables.register_layer(spark, {"kept": f"{folder}/t"}, "lamina_test") == {"kept": "SUCCESS"}
    assert spark.sql("SELECT count(*) FROM lamina_test.kept").first()[0] == 3
    spark.sql("DROP DATABASE lamina_test CASCADE")


def test_dead_letters_hold_every_row(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    rows = tables.dead_letters(df, "e", "run", "Kind", "why", AT).collect()
    assert sorted(r["Payload"] for r in rows) == ['{"id":"a","n":1}', '{"id":"b"}']
    assert len({r["DLQ_ID"] for r in rows}) == 2


def test_work_folder_follows_the_session(spark, monkeypatch):
    from lamina import session

    monkeypatch.setattr(session, "CHECKPOINT_DIR", "spark.lamina.unset")
    first, second = session.work_dir(spark, "x"), session.work_dir(spark, "x")
    assert first.startswith("/tmp/spark-") and first != second and Path(first).parent == Path(second).parent
    spark.conf.set("spark.lamina.unset", "/shared/place/")
    try:
        assert session.work_dir(spark, "x").startswith("/shared/place/x-")
    finally:
        spark.conf.unset("spark.lamina.unset")
    assert not session.path_exists(spark, "/no/such/folder") and session.path_exists(spark, "/tmp")


FORMS = {
    "lines.json": '{"DoctorID": "L1", "Experience": 1}\n\n{"DoctorID": "L2", "Experience": "x"}\n{broken\n{"DoctorID": "L3", "Experience": 3}\n',
    "array.json": '[{"DoctorID": "A1", "Experience": 1}, {"DoctorID": "A2", "Experience": "many"}, null, 5, {"DoctorID": "A3"}]',
    "tall.json": '﻿[\n  {\n    "DoctorID": "T1",\n    "Experience": 1\n  },\n  {"DoctorID": "T2", "Experience": []}\n]\n',
    "objects.json": '{\n  "DoctorID": "O1",\n  "Experience": 1\n}\n{\n  "DoctorID": "O2",\n  "Experience": 2\n}\n',
    "arrays.json": '[{"DoctorID": "R1", "Experience": 1}]\n[{"DoctorID": "R2", "Experience": 2}, {"DoctorID": "R3", "Experience": 3}]',
    "cut.json": '[{"DoctorID": "C1", "Experience": 1},\n',
    "twice.json": '{"DoctorID": "W1", "Experience": 1} {"DoctorID": "W2", "Experience": 2}',
    "none.json": "[]",
    "blank.json": " \n\n",
}
GOOD = ["A1", "A3", "L1", "L3", "O1", "O2", "R1", "R2", "R3", "T1"]
BAD = [
    "5", "null", '[{"DoctorID": "C1", "Experience": 1},', '{"DoctorID": "L2", "Experience": "x"}', '{"DoctorID": "W1", "Experience": 1} {"DoctorID": "W2", "Experience": 2}',
    '{"DoctorID":"A2","Experience":"many"}', '{"DoctorID":"T2","Experience":[]}', "{broken",
]


def every_form(folder):
    for name, text in FORMS.items():
        path = Path(folder) / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return f"{folder}/in"


def test_json_files_of_every_form_lose_nothing(spark, folder):
    df = landing.scan_json(spark, every_form(folder), DOCTORS)
    good, bad = landing.split_bad_records(df)
    assert sorted(r["DoctorID"] for r in good.collect()) == GOOD
    assert sorted(r["_rescued_data"] for r in bad.collect()) == sorted(BAD)
    names = {r["DoctorID"]: r["_source_file"].rsplit("/", 1)[-1] for r in good.collect()}
    assert (names["A1"], names["T1"], names["O2"]) == ("array.json", "tall.json", "objects.json")
    # A bad value leaves the others of its row readable.
    assert df.where("DoctorID = 'A2'").first()["Experience"] is None
    # Rescue does not depend on the columns that are asked for.
    assert landing.rescued_rows(df).select("DoctorID").count() == len(BAD)
    assert landing.scan_json(spark, put(folder, "blank/a.json", ""), DOCTORS).isEmpty()


def test_json_forms_are_found_per_file(spark, folder):
    forms = landing.json_forms(spark, every_form(folder))
    short = {spans: sorted(f.rsplit("/", 1)[-1] for f in files) for spans, files in forms.items()}
    assert short == {True: ["cut.json", "objects.json", "tall.json"], False: ["array.json", "arrays.json", "lines.json", "none.json", "twice.json"]}


def test_json_new_fields_in_mixed_forms(spark, folder):
    put(folder, "in/a.json", '{"DoctorID": "D1", "Pager": "P1"}', '{"DoctorID": "D2", "Fax": 7}')
    put(folder, "in/b.json", "[", ' {"DoctorID": "D3", "Pager": {"home": 1}}', "]")
    rows = {r["DoctorID"]: r for r in landing.scan_json(spark, f"{folder}/in", DOCTORS, "addNewColumns").collect()}
    assert (rows["D1"]["Pager"], rows["D2"]["Fax"], rows["D3"]["Pager"]) == ("P1", "7", '{"home":1}')


def test_json_streams_of_every_form(spark, folder):
    path = every_form(folder)
    good = ingest_all(spark, folder, fmt="json", bad_target=f"{folder}/bad")
    assert sorted(r["DoctorID"] for r in good.collect()) == GOOD
    assert sorted(r["_rescued_data"] for r in spark.read.parquet(f"{folder}/bad").collect()) == sorted(BAD)
    stream = stream_landing(spark, path, DOCTORS, "json")
    stream.writeStream.format("memory").queryName("every_form").trigger(availableNow=True).start().awaitTermination()
    direct = spark.table("every_form")
    assert sorted(r["DoctorID"] for r in direct.where("_rescued_data IS NULL").collect()) == GOOD
    assert sorted(r["_rescued_data"] for r in landing.rescued_rows(direct).collect()) == sorted(BAD)


def test_form_of_json_files_is_told_without_moving_their_lines(spark, folder, monkeypatch):
    """A line may be a whole array, so only flags are grouped: text would have to be sorted for it."""
    spark.createDataFrame([('[{"a":1},{"a":2}]',)], "value string").coalesce(1).write.text(f"{folder}/flat")
    spark.createDataFrame([('[{"a":1},',), ('{"a":2}]',)], "value string").coalesce(1).write.text(f"{folder}/tall")
    kinds, first = [], F.first
    monkeypatch.setattr(landing.F, "first", lambda c: kinds.append(spark.sql("SELECT 'x' AS value, 'x' AS line").select(first(c)).dtypes[0][1] if not isinstance(c, str) else "string") or first(c))
    forms = landing.json_forms(spark, [f"{folder}/flat", f"{folder}/tall"])
    assert {spans: len(files) for spans, files in forms.items()} == {True: 1, False: 1} and kinds == ["boolean"]
