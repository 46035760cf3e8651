from datetime import date, datetime

import pytest

from stowline.fixed_values import (
    KEY_FUNCTION,
    KEY_GROUP_SYMBOLS,
    KEY_MINUTES,
    KEY_SLOT_COUNT,
    KEY_SYMBOLS_PER_REQUEST,
    KEY_TEMPLATE,
)
from stowline.plans import cleanup, extraction, quota, retention, usage
from stowline.sources.inventory import inventory_from_rows
from stowline.sources.texts import listing_rows

OLD, NEW = datetime(2015, 1, 1), datetime(2025, 1, 1)
NOW = "2025-02-01 00:00:00"


@pytest.fixture
def inventory(spark):
    return inventory_from_rows(
        spark,
        [
            ("/project/abcd/model/cd-bm/f1", False, 3 * 1024, OLD),
            ("hdfs://nn:8020/project/abcd/model/cd-bm/f2", False, 1024, NEW),
            ("/project/abcd/feed/cd-zz/f3", False, 10, OLD),
            ("/project/abcd/misc/cd-bm/f4", False, 99, OLD),
        ],
    )


def test_usage_by_team(inventory):
    rows = [tuple(r) for r in usage.usage_by_team(inventory).collect()]
    assert rows == [("model", "bm", 4096, "4.00 KB"), ("feed", "other", 10, "10 B")]
    rows = [tuple(r) for r in usage.old_usage_by_team(inventory, NOW).collect()]
    assert rows == [("model", "bm", 3072, "3.00 KB"), ("feed", "other", 10, "10 B")]


def test_old_path_lists_hold_every_path_in_bounded_parts(spark):
    rows = [(f"/project/abcd/model/cd-bm/f{n}", False, 1, OLD) for n in range(2000)]
    lists = usage.old_path_lists(inventory_from_rows(spark, rows), NOW, paths_per_list=100).collect()
    assert len(lists) > 10 and max(len(r.old_file_paths) for r in lists) < 300
    assert sorted(sum((list(r.old_file_paths) for r in lists), [])) == sorted(row[0] for row in rows)
    assert {r.old_size_bytes for r in lists} == {2000}


def test_group_wise_usage_shows_expected_paths(spark):
    rows = [
        ("/project/abcd/efgh/ijkl/model/x-bm-y/f", False, 1500, NEW),
        ("/project/abcd/efgh/ijkl/model/none/f", False, 5, NEW),
        ("/project/abcd/efgh/ijkl/model/loose", False, 77, NEW),
    ]
    table = usage.group_wise_usage(inventory_from_rows(spark, rows)).collect()
    assert [r.base_path.rsplit("/", 1)[1] for r in table] == ["alert", "feed", "model", "process"]
    assert [(r.ib, r.bm, r.others) for r in table] == [("", "", ""), ("", "", ""), ("", "1.5 KB", "5.0 B"), ("", "", "")]


def test_old_directory_summary_lines(spark):
    lines = spark.createDataFrame(
        [("/project/abcd/efgh/ijkl/model/x-bm", "1 TB"), ("/short", "2 GB"), ("/project/abcd/efgh/ijkl/feed/x-bm", "1 GB")],
        "path string, size string",
    )
    found = [r.line for r in usage.old_directory_summary(lines).collect()]
    assert found == [
        "bm size in /project/abcd/efgh/ijkl/feed = 1.00 GB",
        "bm size in /project/abcd/efgh/ijkl/model = 1.00 TB",
        "other size in /project/abcd/efgh/ijkl/unknown = 2.00 GB",
        "bm size for old dirs = 1.00 TB",
        "other size for old dirs = 2.00 GB",
    ]


def test_quota_line(spark):
    lines = spark.createDataFrame(
        [
            ("200000 4726 17598478645673 14499787842345 52697 142577 1560987564123 /project/stadgcsv",),
            ("none inf none inf 1 2 3 /p/unset",),
            ("0 0 0 5 1 2 3 /p/zero",),
            ("1 2 3 4 5 6 7 /p extra",),
            ("too short",),
        ],
        "value string",
    )
    first, unset, zero, long, short = quota.quota_report(lines).collect()
    assert (first.ns_used, first.ns_pct) == (195274, 97.64)
    assert (first.space_quota_tb, first.space_used_tb, first.space_pct) == (16.01, 13.19, 82.39)
    assert first.ns_alert and first.space_alert and not first.error
    assert unset.error and unset.location == "/p/unset" and unset.ns_quota == 0
    assert (zero.ns_pct, zero.space_pct, zero.error) == (0.0, 0.0, False)
    assert long.error and short.error and short.location == "too short"
    remaining = quota.quota_report(lines, "remaining").first()
    assert remaining.space_used_tb == round((17598478645673 - 14499787842345) / 1024**4, 2)


@pytest.mark.parametrize(
    "names, now, strict, expected",
    [
        (["scheduled_deletion_20250415"], "2025-04-14 09:00:00", False, (0, "delete")),
        (["scheduled_deletion_20250415"], "2025-04-14 09:00:00", True, (0, "remind")),
        (["scheduled_deletion_20250415"], "2025-04-15 09:00:00", True, (-1, "delete")),
        (["scheduled_deletion_20250415", "scheduled_deletion_20250413"], "2025-04-11 09:00:00", False, (1, "remind")),
        (["scheduled_deletion_20250415"], "2025-04-11 09:00:00", False, (3, "remind")),
        (["scheduled_deletion_20250415"], "2025-04-16 00:00:00", False, (None, "schedule")),
        (["other"], "2025-04-16 00:00:00", False, (None, "schedule")),
    ],
)
def test_cycle_phase(spark, names, now, strict, expected):
    rows = spark.createDataFrame([(name,) for name in names], "name string")
    row = cleanup.cycle_status(rows, now, strict).first()
    assert (row.days_left, row.phase) == expected
    assert str(row.planned_date) == ("2025-04-20" if row.phase == "schedule" else "None")


def test_listing_lines(spark):
    lines = [
        "-rw-r--r--   3 u g 1024 2022-03-31 23:59 /p/a/file one.txt",
        "drwxr-xr-x   - u g    0 2022-04-01 00:00 /p/a/20220331",
        "-rw-r--r--   3 u g   10 2022-99-01 00:00 /p/bad",
        "Found 3 items",
    ]
    rows = listing_rows(spark.createDataFrame([(line,) for line in lines], "value string"))
    assert {(r.path, r.is_dir, r.length) for r in rows.collect()} == {
        ("/p/a/file one.txt", False, 1024), ("/p/a/20220331", True, 0),
    }
    assert [r.path for r in retention.before_date(rows, "2022-04-01").collect()] == ["/p/a/file one.txt"]
    dated = retention.dated_directories(rows.filter("is_dir"), 20220401)
    assert [r.path for r in dated.collect()] == ["/p/a/20220331"]
    assert retention.dated_directories(rows.filter("is_dir"), 20220331).count() == 0


def test_age_filter_is_strict_and_reaches_the_scan(spark, tmp_path):
    rows = [("/a", False, 1, datetime(2025, 1, 22)), ("/b", False, 1, datetime(2025, 1, 21, 23, 59)), ("/d", True, 0, OLD)]
    inventory_from_rows(spark, rows).write.parquet(str(tmp_path / "inv"))
    stored = spark.read.parquet(str(tmp_path / "inv"))
    old = retention.older_than(stored, NOW, 10)
    assert {r.path for r in old.collect()} == {"/b", "/d"}
    assert {r.path for r in retention.older_than(stored, NOW, 10, only_files=True).collect()} == {"/b"}
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(mtime,2025-01-22" in plan


def test_markers_count_whole_days_inclusive(spark):
    rows = [
        ("/x/_SUCCESS", False, 0, datetime(2025, 1, 29)),
        ("/y/_SUCCESS", False, 0, datetime(2025, 1, 29, 0, 0, 1)),
        ("/z/_SUCCESS2", False, 0, OLD),
    ]
    found = retention.old_markers(inventory_from_rows(spark, rows), NOW, 3)
    assert [(r.path, r.age_days) for r in found.collect()] == [("/x/_SUCCESS", 3)]


def test_final_list_and_lookup(spark):
    table = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    left = cleanup.final_list(table("/a/b/f", "/a/b/f", "/a/c/f", "/a/bc"), table("/a/b/"), table("/q"))
    assert sorted(r.path for r in left.collect()) == ["/a/bc", "/a/c/f"]
    assert retention.is_listed(table(" /a ", "/b"), "/a ").count() == 1
    assert retention.is_listed(table("/ab"), "/a").count() == 0
    found = retention.listed_terms(table(" /a", "/b", "/b"), spark.createDataFrame([("/b",), ("/c",)], "term string"))
    assert [r.term for r in found.collect()] == ["/b"]


def test_endpoint_days_come_twice_when_equal(spark):
    raw = spark.createDataFrame(
        [(0, "B", "2025-03-07T10:00:00Z", "2025-03-07T10:05:00Z"), (1, "A", "bad", "")],
        "row_key bigint, ric string, start_text string, end_text string",
    )
    rows = extraction.endpoint_day_requests(raw).orderBy("day_no").collect()
    assert [(r.day_no, str(r.day), list(r.syms)) for r in rows] == [(0, "2025-03-07", ["A", "B"]), (1, "2025-03-07", ["A", "B"])]
    assert rows[0].end == datetime(2025, 3, 7, 23, 59, 59, 999000)
    assert extraction.endpoint_day_requests(raw, all_days=True).count() == 1
    single = {
        KEY_TEMPLATE: "x", KEY_FUNCTION: "f", KEY_SLOT_COUNT: "0", KEY_GROUP_SYMBOLS: "n", KEY_SYMBOLS_PER_REQUEST: "9", KEY_MINUTES: "60",
    }
    alone = extraction.templated_requests(raw, single)
    assert sorted((r.day_no, tuple(r.syms)) for r in alone.collect()) == [(0, ("A",)), (0, ("B",)), (1, ("A",)), (1, ("B",))]


def test_all_days_reach_a_stray_last_date(spark):
    schema = "row_key bigint, ric string, start_text string, end_text string"
    rows = [(at, f"S{at:03}", "2025-03-07T10:00:00Z", "2025-03-07T10:05:00Z") for at in range(25)]
    stray = spark.createDataFrame([*rows, (99, "S000", "2025-03-07T10:00:00Z", "9999-12-31T10:00:00Z")], schema)
    days = extraction._day_batches(stray, 1440, 25, True)
    count, first, last, numbers = days.selectExpr("count(*)", "min(day)", "max(day)", "count(distinct day_no)").first()
    wanted = (date(9999, 12, 31) - date(2025, 3, 7)).days + 1
    assert (count, str(first), str(last), numbers) == (wanted, "2025-03-07", "9999-12-31", wanted)
    assert days.selectExpr("max(abs(datediff(day, date'2025-03-07') - day_no))").first()[0] == 0
    backwards = spark.createDataFrame([(0, "A", "2025-03-07T10:00:00Z", "2025-03-01T10:05:00Z")], schema)
    assert extraction.endpoint_day_requests(backwards, all_days=True).count() == 0


def test_slot_requests_use_the_first_day_in_file_order(spark):
    raw = spark.createDataFrame(
        [(0, "A", "", ""), (1, "A", "2025-03-09T10:00:00Z", ""), (2, "B", "2025-03-07T10:00:00Z", "")],
        "row_key bigint, ric string, start_text string, end_text string",
    )
    rows = extraction.slot_requests(raw, 720).orderBy("start").collect()
    assert [str(r.start) for r in rows] == ["2025-03-09 00:00:00", "2025-03-09 12:00:00"]
    assert "`$(\"A\"; \"B\")" in rows[0].request and "2025.03.09;00:00:00.000;2025.03.09;11:59:59.999" in rows[0].request
