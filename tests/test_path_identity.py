"""Protection by path identity, versions of any length, dates of rows without a symbol, sizes out of range."""

import pytest
from pyspark.sql import functions as F

from stowline.functions.sizes import parse_size, size_too_large
from stowline.operators.filesystem import delete_paths
from stowline.operators.prefix import anti_join_by_order, exclude_below, exclusion_keys
from stowline.operators.versions import latest_versions, old_versions
from stowline.plans import extraction
from stowline.sources import interest, inventory


def paths(spark, *values):
    return spark.createDataFrame([(value,) for value in values], "path string")


def test_exclusions_meet_paths_under_any_spelling(spark):
    given = paths(spark, "hdfs://nn:8020/p/x/f", "/p/x/g", "hdfs://nn:8020/p/xy", "file:///p/q/z", "/p/y", "hdfs://nn:8020/p/y/z")
    excluded = paths(spark, "/p/x", "hdfs://nn:8020/p/y/", "file:/p/q")
    assert [row.path for row in exclude_below(given, excluded).collect()] == ["hdfs://nn:8020/p/xy"]
    keys = exclusion_keys(excluded)
    assert [row.path for row in anti_join_by_order(given, keys).collect()] == ["hdfs://nn:8020/p/xy"]


def test_bare_paths_belong_to_the_default_file_system(spark, tmp_path, monkeypatch):
    (tmp_path / "keep").write_text("x")
    monkeypatch.setattr(inventory, "default_file_system", lambda session: "nosuch://nn:8020")
    listed = paths(spark, str(tmp_path / "keep"))
    assert [row.q for row in listed.select(inventory.qualified(spark, "path").alias("q")).collect()] == [f"nosuch://nn:8020{tmp_path}/keep"]
    status = delete_paths(listed, str(tmp_path), dry_run=False).first()
    assert status.path.startswith("nosuch://") and status.status.startswith("Error")
    assert (tmp_path / "keep").exists()


def test_the_hadoop_configuration_names_the_default(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://nn:8020/")
        assert inventory.qualify(spark, "/p") == "hdfs://nn:8020/p"
        assert inventory.qualify(spark, "file:/p") == "file:/p"
    finally:
        conf.set("fs.defaultFS", before)
    assert inventory.qualify(spark, "/p") == "/p"


def test_protected_paths_under_any_spelling(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("x")
    listed = paths(spark, f"file:{tmp_path}/a", f"{tmp_path}/b/")
    assert delete_paths(listed, str(tmp_path), dry_run=False, protected=(f"{tmp_path}/a", f"{tmp_path}/b")).count() == 0


def test_versions_of_any_length(spark):
    long = "9" * 40
    names = ["1.0", "1", f"{long}", f"0{long}.1", "1." + "1" + "0" * 45, "1." + "9" * 45]
    given = spark.createDataFrame([("/a", name, f"/a/{name}") for name in names[:4]] + [("/b", name, f"/b/{name}") for name in names[4:]], "parent string, name string, path string")
    assert dict(map(tuple, latest_versions(given).collect())) == {"/a": f"0{long}.1", "/b": "1.1" + "0" * 45}
    assert {row.name for row in old_versions(given).collect()} == {"1.0", "1", long, "1." + "9" * 45}


def test_sizes_of_any_length(spark):
    given = ["9000000 TB", "8000000 TB", "123456789012345.7 TB", "-9000001.3 TB", "1e40 TB", "1e16 TB", "1.9 B"]
    rows = spark.createDataFrame([(text,) for text in given], "size string").select(parse_size(F.col("size")), size_too_large(F.col("size"))).collect()
    expected = [int(float(text.split()[0]) * (1024**4 if "TB" in text else 1)) for text in given]
    assert [row[0] for row in rows] == [size if abs(size) < 10**30 else None for size in expected]
    assert [row[1] for row in rows] == [abs(size) >= 10**30 for size in expected]


def rows_of(spark, *rows):
    made = spark.createDataFrame([(at, *row) for at, row in enumerate(rows)], "k long, ric string, s string, e string")
    return interest.raw_interest(made, "ric", "s", "e", F.col("k"))


def test_dates_come_from_all_rows(spark):
    day = lambda text: f"2025-{text}T10:00:00.000Z"
    raw = rows_of(spark, ("", day("03-01"), day("03-01")), ("A", day("03-07"), day("03-07")), (None, day("04-07"), day("04-07")))
    found = extraction.interest_range(raw).first()
    assert (str(found.start_day), str(found.end_day)) == ("2025-03-01", "2025-04-07")
    assert [row.ric for row in interest.interest_windows(raw).collect()] == ["A"]
    assert str(extraction.first_day(raw).first().day) == "2025-03-01"


def test_no_readable_day_gives_no_request(spark):
    raw = rows_of(spark, ("A", "bad", "bad"), ("B", None, None))
    assert extraction.endpoint_day_requests(raw).count() == 0
    assert extraction.endpoint_day_requests(raw, all_days=True).count() == 0
    assert extraction.slot_requests(raw).count() == 0
