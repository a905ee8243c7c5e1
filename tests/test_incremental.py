"""After a change of files, tables equal a full rebuild and other parts keep their files."""

import gzip
import os

from pyspark.sql import functions as F

from landmarkflow.sources.clinical import TABLES, read_table
from landmarkflow.sources.incremental import bucket, stage_changes, update_step

COLUMNS = [c for c, _ in TABLES["outputevents"][1]]
B = 16


def put(root, part, rows):
    """One raw file of (patient, hour, value) rows; the column order is not the layout's."""
    folder = root / "icu" / "outputevents.csv.gz"
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / f"{part}.csv.gz", "wt") as f:
        f.write(",".join(reversed(COLUMNS)) + "\n")
        for p, hour, value in rows:
            of = dict(subject_id=p, hadm_id=p, stay_id=p, caregiver_id="", itemid=226559,
                      charttime=f"2150-01-01 {hour:02d}:10:00", storetime="", value=value,
                      valueuom="mL")
            f.write(",".join(str(of[c]) for c in reversed(COLUMNS)) + "\n")


def run(spark, root, out):
    staged = stage_changes(spark, str(root), "outputevents", str(out), buckets=B)

    def hourly(t):
        return t["o"].groupBy("subject_id", F.hour("charttime").alias("hour")).agg(
            F.sum("value").alias("total"), F.count("*").alias("n"))

    table = update_step(spark, "hourly", str(out), hourly, {"o": staged}, buckets=B)
    whole = read_table(spark, str(root), "outputevents")
    assert sorted(map(str, staged.rows.collect())) == sorted(map(str, whole.collect()))
    assert sorted(table.collect()) == sorted(hourly({"o": whole}).select(*table.columns).collect())
    assert set(table.columns) == {"subject_id", "hour", "total", "n"}
    return staged, table


def of(spark, *patients):
    df = spark.createDataFrame([(p,) for p in patients], "subject_id bigint")
    return sorted({r[0] for r in df.select(bucket("subject_id", B)).collect()})


def used(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_files_come_change_and_go(spark, tmp_path):
    root, out = tmp_path / "raw", tmp_path / "staged"
    hot = [(1, h % 24, h) for h in range(60)]
    put(root, "a", hot + [(2, 1, 5), (2, 1, 5)])
    put(root, "b", [(3, 4, 7), (4, 5, "")])
    put(root, "c", [(p, 2, p) for p in range(10, 40)])
    first, table = run(spark, root, out)
    assert first.changed == of(spark, 1, 2, 3, 4, *range(10, 40))
    staged_files, step_files = used(first.rows), used(table)

    nothing, _ = run(spark, root, out)
    assert nothing.changed == [] and used(nothing.rows) == staged_files

    put(root, "b", [(3, 4, 8), (4, 5, "")])  # one value of patient 3
    second, table = run(spark, root, out)
    assert second.changed == of(spark, 3)
    assert len(used(second.rows) - staged_files) == 1 and len(staged_files - used(second.rows)) == 1
    gone = step_files - used(table)
    assert gone and all(f"bucket={of(spark, 3)[0]}/" in f for f in gone | (used(table) - step_files))

    put(root, "d", [(5, 1, 1), (3, 9, 9)])  # a new file
    assert run(spark, root, out)[0].changed == of(spark, 5, 3)
    os.remove(root / "icu" / "outputevents.csv.gz" / "a.csv.gz")
    third, table = run(spark, root, out)
    assert third.changed == of(spark, 1, 2)
    assert table.filter("subject_id in (1, 2)").count() == 0


def test_touched_and_moved_rows_change_nobody(spark, tmp_path):
    root, out = tmp_path / "raw", tmp_path / "staged"
    put(root, "a", [(1, 1, 1), (2, 2, 2)])
    put(root, "b", [(3, 3, 3)])
    run(spark, root, out)
    folder = root / "icu" / "outputevents.csv.gz"
    os.utime(folder / "a.csv.gz", (1e9, 1e9))
    assert run(spark, root, out)[0].changed == []
    put(root, "a", [(2, 2, 2)])  # a row moves to another file
    put(root, "b", [(3, 3, 3), (1, 1, 1)])
    assert run(spark, root, out)[0].changed == []
    put(root, "a", [])  # a file of a header alone
    assert run(spark, root, out)[0].changed == of(spark, 2)


def test_a_step_catches_up(spark, tmp_path):
    root, out = tmp_path / "raw", tmp_path / "staged"
    put(root, "a", [(1, 1, 1), (2, 2, 2)])
    put(root, "b", [(3, 3, 3)])
    _, table = run(spark, root, out)
    before = used(table)
    put(root, "a", [(1, 1, 9), (2, 2, 2)])
    stage_changes(spark, str(root), "outputevents", str(out), buckets=B)
    put(root, "b", [(3, 3, 9)])
    staged, table = run(spark, root, out)  # two generations behind
    assert staged.changed == of(spark, 3)
    assert {r["subject_id"]: r["total"] for r in table.collect()} == {1: 9.0, 2: 2.0, 3: 9.0}
    assert len(before & used(table)) >= 1


def test_a_run_that_died_is_repeated(spark, tmp_path, monkeypatch):
    from landmarkflow.sources import incremental

    root, out = tmp_path / "raw", tmp_path / "staged"
    put(root, "a", [(1, 1, 1)])
    run(spark, root, out)
    put(root, "a", [(1, 1, 2)])
    with monkeypatch.context() as m:
        m.setattr(incremental, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        try:
            stage_changes(spark, str(root), "outputevents", str(out), buckets=B)
        except RuntimeError:
            pass
    staged, table = run(spark, root, out)
    assert staged.changed == of(spark, 1) and table.first()["total"] == 2.0
