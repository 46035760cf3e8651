import os

import pytest

from stowline.plans import jobs
from stowline.sinks.files import append_path_list
from stowline.sources.inventory import list_tree


@pytest.fixture
def conf(spark):
    names = []

    def set_value(name, value):
        names.append(f"spark.cleanup.{name}")
        spark.conf.set(f"spark.cleanup.{name}", str(value))

    yield set_value
    for name in names:
        spark.conf.unset(name)


@pytest.fixture
def data(tmp_path):
    for path, size in [("data/a/f1", 1500), ("data/a/b/f2", 5), ("data/c/_SUCCESS", 0), ("data/c/f3", 1)]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"." * size)
        os.utime(tmp_path / path, (1_500_000_000, 1_500_000_000))
    return tmp_path


def test_directory_sizes(spark, conf, data):
    conf("basePath", data / "data")
    conf("recursiveLevel", 2)
    conf("outputPath", data / "out")
    jobs.directory_size_job(spark)
    found = spark.read.csv(str(data / "out"), header=True)
    assert {(r.path[len(str(data)) :], r.size_bytes, r.size_human_readable) for r in found.collect()} == {
        ("/data/a", "1505", "1.5 kB"), ("/data/a/b", "5", "5 B"), ("/data/c", "1", "1 B"),
    }


def test_listed_sizes(spark, conf, data):
    (data / "list.txt").write_text(f"{data}/data/a\n{data}/none\n")
    conf("inputPath", data / "list.txt")
    conf("outputPath", data / "report")
    written = jobs.listed_size_job(spark)
    rows = spark.read.csv(written, header=True, schema="path string, size string").collect()
    assert {tuple(row) for row in rows} == {(f"{data}/data/a", "1.5 KB"), (f"{data}/none", "INVALID_PATH")}


def test_settings_without_default_must_be_set(spark):
    with pytest.raises(ValueError):
        jobs.setting(spark, "inputPath")


def test_markers_and_deletes(spark, conf, data):
    conf("basePath", data / "data")
    statuses, _ = jobs.marker_job(spark, "2025-01-01", dry_run=False)
    assert [r.path for r in statuses.collect()] == [f"{data}/data/c/_SUCCESS"]
    (data / "list.txt").write_text(f" {data}/data/c \n\n")
    conf("inputPath", data / "list.txt")
    assert jobs.delete_job(spark, str(data / "data")).count() == 1 and (data / "data/c/f3").exists()
    jobs.delete_job(spark, str(data / "data"), dry_run=False)
    assert not (data / "data/c").exists()


def test_group_usage(spark, data):
    base = data / "data"
    (base / "model/x-ib").mkdir(parents=True)
    (base / "model/x-ib/f").write_bytes(b"." * 2000)
    rows = {r.base_path: r for r in jobs.group_usage_job(spark, str(base)).collect()}
    assert rows[f"{base}/model"].ib == "2.0 KB" and rows[f"{base}/feed"].ib == ""


def test_cycle_from_schedule_to_deletion(spark, data):
    folder = data / "cycles"
    folder.mkdir()
    (data / "permanent.txt").write_text(f"{data}/data/c/\n")
    inventory = list_tree(spark, str(data / "data")).filter("not is_dir")
    common = dict(permanent=str(data / "permanent.txt"), allowed_root=str(data / "data"), dry_run=False)
    phase, scheduled = jobs.cycle_job(spark, inventory, str(folder), "2025-01-01 09:00:00", **common)
    assert phase == "schedule"
    assert {r.path for r in scheduled.collect()} == {f"{data}/data/a/f1", f"{data}/data/a/b/f2"}
    assert jobs.cycle_job(spark, inventory, str(folder), "2025-01-02 09:00:00", **common) == ("remind", None)
    own = spark.createDataFrame([(f"{data}/data/a/b",)], "path string")
    append_path_list(own, str(folder / "scheduled_deletion_20250105/exclusions_20250105.txt"))
    phase, statuses = jobs.cycle_job(spark, inventory, str(folder), "2025-01-04 09:00:00", **common)
    assert phase == "delete"
    assert [(r.path, r.status) for r in statuses.collect()] == [(f"{data}/data/a/f1", "File Deleted (Skip Trash)")]
    assert (data / "data/a/b/f2").exists() and (data / "data/c/f3").exists() and not (data / "data/a/f1").exists()


def test_tick_filter_and_requests(spark, data):
    (data / "interest.csv").write_text(
        "c0,c1,RIC,c3,c4,Execution_Start_Time,Execution_End_Time\n"
        ",,A,,,2025-03-07T10:00:00.000Z,2025-03-07T10:01:00.000Z\n"
        ",,B,,,2025-03-07T10:00:30.000Z,2025-03-07T10:02:00.000Z\n"
    )
    rows = ["2025-03-07,10:01:00.000,A,1", "2025-03-07,10:01:00.001,A,2", "2025-03-07,10:01:00.001,B,3", "2025-03-07,10:01:00.001,B,3"]
    (data / "ticks.csv").write_text("date_column,time_column,sym,price\n" + "\n".join(rows) + "\n")
    jobs.tick_filter_job(spark, str(data / "interest.csv"), str(data / "ticks.csv"), str(data / "kept"), 2)
    kept = spark.read.csv(str(data / "kept"), header=True)
    assert sorted(r.price for r in kept.collect()) == ["1", "3"]
    jobs.window_request_job(spark, str(data / "interest.csv"), str(data / "requests"))
    lines = [r.value for r in spark.read.text(str(data / "requests")).collect()]
    assert len(lines) == 1 and lines[0].endswith(';0b;2025.03.07;10:00:00.000;2025.03.07;10:02:00.000;`$"";`$("A"; "B"))]')
