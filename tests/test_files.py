import os
from datetime import datetime

import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from stowline.operators import filesystem
from stowline.operators.filesystem import OUTSIDE_ROOT, delete_paths, journal_statuses, outcome_counts
from stowline.plans import cleanup, extraction
from stowline.sinks import files
from stowline.sources import interest, inventory, texts


@pytest.fixture
def root(tmp_path):
    for path, size in [("a/x/f1", 10), ("a/x/_SUCCESS", 0), ("a/y/f 2", 5), ("b/.hidden", 3), ("c/deep/er/f3", 7)]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"." * size)
    (tmp_path / "empty").mkdir()
    return tmp_path


def names(df, root):
    return {r.path[len(str(root)) + 1 :] for r in df.select("path").collect()}


def test_tree_listing(spark, root):
    found = inventory.list_tree(spark, str(root))
    assert names(found.filter("is_dir"), root) == {"a", "a/x", "a/y", "b", "c", "c/deep", "c/deep/er", "empty"}
    assert {(r.path[len(str(root)) + 1 :], r.length) for r in found.filter("not is_dir").collect()} == {
        ("a/x/f1", 10), ("a/x/_SUCCESS", 0), ("a/y/f 2", 5), ("b/.hidden", 3), ("c/deep/er/f3", 7),
    }
    assert names(inventory.list_tree(spark, str(root), max_depth=1), root) == {"a", "b", "c", "empty"}
    assert inventory.list_tree(spark, str(root), max_depth=0).count() == 0
    assert inventory.list_tree(spark, str(root / "missing")).count() == 0
    assert names(inventory.one_level_directories(spark, str(root / "c")), root) == {"c/deep"}


def test_tree_listing_takes_uris_and_nested_roots_once(spark, root):
    found = inventory.list_tree(spark, [f"file://{root}/c", f"file://{root}/c/deep/"])
    assert sorted(r.path for r in found.collect()) == [
        f"file://{root}/c/deep", f"file://{root}/c/deep/er", f"file://{root}/c/deep/er/f3",
    ]


def test_only_the_outermost_roots_are_walked(spark):
    given = ["/", "/a", "/a/b/", "hdfs://nn/x", "hdfs://nn/x/y", "hdfs://nn/xy"]
    roots = spark.createDataFrame([(p,) for p in given], "path string")
    assert sorted(r.path for r in inventory.outermost(roots).collect()) == ["/", "hdfs://nn/x", "hdfs://nn/xy"]
    roots = spark.createDataFrame([("/a/b",), ("/a",), ("/ab",)], "path string")
    assert sorted(r.path for r in inventory.outermost(roots).collect()) == ["/a", "/ab"]


def test_pruned_subtrees_are_not_listed(spark, root):
    pruned = spark.createDataFrame([(f"{root}/a/",), (f"{root}/c/deep/er/f3",)], "path string")
    assert names(inventory.list_tree(spark, str(root), pruned), root) == {"b", "b/.hidden", "c", "c/deep", "c/deep/er", "empty"}


def test_binary_listing_hides_empty_and_hidden_files(spark, root):
    found = inventory.binary_listing(spark, str(root))
    assert sorted(r.length for r in found.collect()) == [5, 7, 10]


def test_live_sizes(spark, root):
    listed = spark.createDataFrame([(f"{root}/a",), (f"{root}/empty",), (f"{root}/nope",), (f"{root}/a/x/f1",)], "path string")
    broken = spark.createDataFrame([("nosuchscheme://host/place",)], "path string")
    assert [(r.size_bytes, r.status, r.size) for r in cleanup.live_sizes(broken).collect()] == [(None, "ERROR", "ERROR")]
    found = {r.path[len(str(root)) + 1 :]: (r.size_bytes, r.size) for r in cleanup.live_sizes(listed).collect()}
    assert found["a"] == (15, "15 B")
    assert found["nope"] == (None, "INVALID_PATH")
    assert found["a/x/f1"] == (None, "INVALID_PATH")
    assert found["empty"] == (0, "0 B")


def test_deletes_run_once_and_only_inside_the_root(spark, root):
    wanted = [f" {root}/a/x ", f"{root}/a/y/f 2", f"{root}/nope", "/", ".", " ", "/etc/hostname", f"{root}/c/../b", f"{root}", f"{root}/c"]
    listed = spark.createDataFrame([(p,) for p in wanted], "path string")
    trial = delete_paths(listed, str(root), protected=(f"{root}/c",))
    assert os.path.exists(root / "a/x/f1") and trial.count() == 6
    done = delete_paths(listed, str(root), dry_run=False, protected=(f"{root}/c",))
    first = {r.path: r.status for r in done.collect()}
    assert first == {r.path: r.status for r in done.collect()}
    assert first[f"{root}/a/x"] == "Directory Deleted (Skip Trash)"
    assert first[f"{root}/a/y/f 2"] == "File Deleted (Skip Trash)"
    assert first[f"{root}/nope"] == "File Not Found"
    assert first["/etc/hostname"] == first[f"{root}/c/../b"] == first[str(root)] == OUTSIDE_ROOT
    assert os.path.exists("/etc/hostname") and (root / "b").exists() and (root / "c").exists()
    assert {r.status: r.paths for r in outcome_counts(done).collect()}[OUTSIDE_ROOT] == 3


def test_a_retried_task_reports_its_own_deletes(root, tmp_path_factory):
    """The first attempt ends after one delete; the second one gives the statuses that one attempt would have given."""
    book = str(tmp_path_factory.mktemp("book"))
    wanted = [f"{root}/a/x", f"{root}/a/y/f 2", f"{root}/nope", f"{root}/a/x", f"{root}/b", "/etc/hostname"]
    frame = pd.DataFrame({"path": wanted, "allowed": [True] * 5 + [False], "was": [None] * 6})
    seen = []

    def stop(path):
        seen.append(path)
        if len(seen) == 2:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        list(filesystem._delete_job(False, book, stop)(iter([frame])))
    assert not (root / "a/x").exists() and (root / "b").exists()
    (found,) = filesystem._delete_job(False, book)(iter([frame]))
    assert found["status"].tolist() == [
        "Directory Deleted (Skip Trash)", "File Deleted (Skip Trash)", "File Not Found", "File Not Found",
        "Directory Deleted (Skip Trash)", OUTSIDE_ROOT,
    ]


def test_a_new_run_goes_on_with_the_journal(spark, root, tmp_path_factory):
    book = str(tmp_path_factory.mktemp("book"))
    listed = spark.createDataFrame([(f"{root}/{name}",) for name in ("a/x", "b", "c", "nope")], "path string")

    def stop(path):
        if path.endswith("/c"):
            raise RuntimeError("lost")

    assert journal_statuses(spark, book + "/none").count() == 0
    with pytest.raises(PythonException):
        delete_paths(listed, str(root), dry_run=False, journal=book, before=stop)
    result = {row.path[len(str(root)) + 1 :]: row.status for row in delete_paths(listed, str(root), dry_run=False, journal=book).collect()}
    deleted = "Directory Deleted (Skip Trash)"
    assert result == {"a/x": deleted, "b": deleted, "c": deleted, "nope": "File Not Found"}
    kept = {row.path[len(str(root)) + 1 :]: (row.is_dir, row.status) for row in journal_statuses(spark, book).collect()}
    assert kept["c"] == (True, deleted) and "nope" not in kept
    # what is made again afterwards is deleted again, and what was never there stays missing
    (root / "b").mkdir()
    again = {row.path[len(str(root)) + 1 :]: row.status for row in delete_paths(listed, str(root), dry_run=False, journal=book).collect()}
    assert again["b"] == deleted and again["nope"] == "File Not Found" and not (root / "b").exists()


def test_request_lines_keep_their_order(spark, tmp_path):
    rows = spark.range(5000).selectExpr("4999 - id AS position", "'line ' || (4999 - id) AS request").repartition(7)
    files.write_requests(rows, str(tmp_path / "requests"))
    assert [tuple(row) for row in texts.read_numbered_lines(spark, str(tmp_path / "requests")).orderBy("position").collect()] == [
        (at, f"line {at}") for at in range(5000)
    ]


def test_purge_markers(spark, root):
    found = inventory.list_tree(spark, str(root))
    assert cleanup.purge_markers(found, datetime.now(), str(root), dry_run=False)[0].count() == 0
    statuses, counts = cleanup.purge_markers(found, "2100-01-01", str(root), dry_run=False)
    assert [tuple(r) for r in counts.collect()] == [("File Deleted (Skip Trash)", 1)]
    assert not (root / "a/x/_SUCCESS").exists() and (root / "a/x/f1").exists()


def test_deletion_cycle(spark, root):
    listed = spark.createDataFrame([(f"{root}/a/x/f1",), (f"{root}/c/deep",)], "path string")
    keep = spark.createDataFrame([(f"{root}/c",)], "path string")
    paths, statuses = cleanup.run_deletion(listed, [keep], str(root), dry_run=False)
    assert [r.path for r in paths.collect()] == [f"{root}/a/x/f1"]
    assert (root / "c/deep/er/f3").exists() and not (root / "a/x/f1").exists()


def test_path_lists(spark, tmp_path):
    target = str(tmp_path / "list")
    rows = spark.createDataFrame([("/a",), ("/b",)], "path string")
    files.write_path_list(rows, target)
    files.append_path_list(spark.createDataFrame([(" /c ",), ("  ",), ("/a",)], "path string"), target)
    assert sorted(r.path for r in texts.read_path_list(spark, target).collect()) == ["/a", "/b", "/c"]
    assert texts.read_path_list(spark, target, distinct=False).count() == 4
    assert texts.path_list_or_empty(spark, str(tmp_path / "none")).count() == 0
    assert texts.path_list_or_empty(spark, target).count() == 3
    (tmp_path / "raw.txt").write_bytes(b"/ok\n\n/b\xff\n#no\n")
    found = {r.path for r in texts.read_path_list(spark, str(tmp_path / "raw.txt")).collect()}
    assert found == {"/ok", "/b\ufffd", "#no"}
    assert {r.path for r in texts.read_manifest(spark, str(tmp_path / "raw.txt")).collect()} == {"/ok", "/b\ufffd"}


def test_named_csv_replaces_the_old_one_at_every_size(spark, tmp_path):
    for size in (2, 5000, 0, 1):
        rows = spark.range(size).selectExpr("CAST(id AS STRING) AS k", "id AS v").repartition(3)
        written = files.publish_csv(rows, str(tmp_path / "out"), "report.csv")
        assert written == f"{tmp_path}/out/report.csv" and os.path.isdir(written)
        assert os.listdir(tmp_path / "out") == ["report.csv"]
        assert spark.read.csv(written, header=True, schema="k string, v int").count() == size


def test_csv_refuses_to_replace_when_asked(spark, tmp_path):
    rows = spark.createDataFrame([("x",)], "k string")
    files.write_csv(rows, str(tmp_path / "o"), "errorifexists", 2)
    with pytest.raises(Exception):
        files.write_csv(rows, str(tmp_path / "o"), "errorifexists", 2)


def test_interest_csv(spark, tmp_path):
    text = (
        "c0,c1,RIC,c3,c4,Execution_Start_Time,Execution_End_Time\n"
        ',,"AAA.L",,,2025-03-07T10:00:01.1Z,2025-03-07T10:02:00.000Z\n'
        ",,BBB.L,,,bad,2025-03-07T10:02:00.000Z\n"
        ",,,,,2025-03-07T10:00:01Z,2025-03-07T10:02:00Z\n"
        ",,CCC.L,,\n"
    )
    (tmp_path / "i.csv").write_text(text)
    for raw in (interest.read_raw_interest(spark, str(tmp_path / "i.csv")), interest.read_named_interest(spark, str(tmp_path / "i.csv"))):
        assert [(r.ric, r.start.microsecond) for r in interest.interest_windows(raw).collect()] == [("AAA.L", 100000)]
        assert {r.ric for r in interest.rejected_interest(raw).collect()} == {"BBB.L", "CCC.L"}


def test_rows_follow_file_order_over_several_files(spark, tmp_path):
    head = "a,b,RIC,d,e,Execution_Start_Time,Execution_End_Time\n"
    line = ",,S{0},,,2025-03-{1:02d}T10:00:00Z,2025-03-{1:02d}T11:00:00Z\n"
    (tmp_path / "1.csv").write_text(head + line.format(0, 9))
    # larger files are read first
    (tmp_path / "2.csv").write_text(head + "".join(line.format(n, 1 + n % 28) for n in range(1, 3000)))
    for read in (interest.read_raw_interest, interest.read_named_interest):
        raw = read(spark, str(tmp_path))
        assert str(extraction.first_day(raw).first().day)[:10] == "2025-03-09"
        assert [r.ric for r in raw.orderBy("row_key").collect()] == [f"S{n}" for n in range(3000)]
        requests = extraction.window_requests(interest.interest_windows(raw), max_rows=7)
        assert requests.agg(F.sum("rows")).first()[0] == 3000


def test_ticks_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date_column,time_column,sym\n2025-03-07,10:00:01.123,A\nbad,10:00:01.123,A\n")
    assert [r.ts for r in interest.read_ticks(spark, str(tmp_path / "t.csv")).collect()] == [
        datetime(2025, 3, 7, 10, 0, 1, 123000), None,
    ]


def test_du_lines(spark):
    lines = spark.createDataFrame([("123  456 /a",), ("x /b",), ("99",)], "value string")
    assert {(r.path, r.bytes) for r in texts.du_rows(lines).collect()} == {("/a", 123), ("/b", 0), ("99", 0)}
