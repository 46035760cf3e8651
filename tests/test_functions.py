import pytest
from pyspark.sql import functions as F

from stowline.fixed_values import (
    KEY_FUNCTION,
    KEY_SLOT,
    KEY_SLOT_COUNT,
    KEY_TEMPLATE,
    TEAM_KEYWORDS,
    TEAM_PATTERNS,
)
from stowline.functions import classify, paths, requests, sizes, times


def test_scheme_is_cut_in_every_form(values):
    given = ["/a/b", "hdfs://nn:8020/a/b", "file:/a/b", "file:///a/b", "a/b", "s3a://bucket/a"]
    assert values(given, paths.strip_scheme) == ["/a/b", "/a/b", "/a/b", "/a/b", "a/b", "/a"]


def test_normalize(values):
    assert values(["/a/", "/a//", "/", "//", "", "a/"], paths.normalize) == ["/a", "/a", "/", "/", "", "a"]


def test_rebase_needs_a_component_boundary(values):
    given = [
        "hdfs://nn/project/abcd/x/f",
        "/project/abcdef/x",
        "/mnt/project/abcd/project/abcd/y",
        "/mnt/project/abcdef/project/abcd/y",
        "/project/abcd",
    ]
    assert values(given, lambda path: paths.rebase(path, "/project/abcd")) == [
        "/project/abcd/x/f",
        "/project/abcdef/x",
        "/project/abcd/project/abcd/y",
        "/project/abcd/y",
        "/project/abcd",
    ]


def test_parents_names_and_depth(values):
    given = ["/a", "/a/b", "/a/b/c.txt"]
    assert values(given, paths.parent) == ["/", "/a", "/a/b"]
    assert values(given, paths.file_name) == ["a", "b", "c.txt"]
    assert values(["/", *given], paths.depth) == [0, 1, 2, 3]
    assert values(["/a/b/c"], paths.ancestors) == [["/a", "/a/b", "/a/b/c"]]
    assert values(["/a/b/c", "/a"], lambda path: paths.ancestors(path, 2, 2)) == [["/a/b"], []]


def test_relative_name(values):
    given = ["/p/q/x/y", "/p/q", "/p/qr/x"]
    assert values(given, lambda path: paths.relative_to(path, "/p/q")) == ["x/y", "", "p/qr/x"]


def test_embedded_month(values):
    given = ["/a/x20220331_202205.har", "/a/12345.har", "/a/123456789.har", "/a/abc.har"]
    assert values(given, paths.embedded_date) == ["20220331", None, "12345678", None]
    assert values(given, paths.embedded_month) == ["202203", None, "123456", None]


@pytest.mark.parametrize(
    "path, top, team",
    [
        ("/project/abcd/model/cd-alert-bm-lay", "model", "bm"),
        ("hdfs://nn:8020/project/abcd/feed/x-IB/f2", "feed", "ib"),
        ("/project//abcd/model/x-pcc-fi/f", "model", "fi"),
        ("/project/abcd", "unknown", "other"),
        ("/project/abcd/model", "model", "other"),
    ],
)
def test_top_and_team(spark, path, top, team):
    rows = spark.createDataFrame([(path,)], "path string")
    row = classify.with_top_and_team(rows, TEAM_KEYWORDS).first()
    assert (row.top_dir, row.team) == (top, team)


def test_segment_order_comes_before_keyword_order(values):
    words = ["bm", "ib"]
    given = ["/a/b/c/d/e/x-ib/y-bm", "/a/b/c/d/e/z-bm-ib", "/a/b/c/d/bm/zz", "/a"]
    found = values(given, lambda path: classify.keyword_in_segments(F.split(path, "/"), 5, words))
    assert found == ["ib", "bm", "other", "other"]


def test_whole_words_do_not_match_inside_underscores(values):
    given = ["/a/x_bm_y", "/a/x-bm-y", "/a/BM/ib"]
    assert values(given, lambda path: classify.word_in(path, ["ib", "bm"])) == ["others", "bm", "ib"]


def test_pattern_rules(values):
    assert values(["beta_team", "xalpha", "none"], lambda name: classify.pattern_in(name, TEAM_PATTERNS)) == [
        "TeamBeta",
        "TeamAlpha",
        "Other",
    ]


def test_parse_size(values):
    given = ["1.5 GB", " 2  kb ", "INVALID_PATH", "x GB", "5 XB", "5GB", "3 4 MB", "0.0019 KB", "inf GB", ""]
    assert values(given, lambda text: sizes.parse_size(text, 1024)) == [1610612736, 2048, 0, 0, 0, 0, 0, 1, 0, 0]
    assert values(["1.5 GB", "2 PB"], lambda text: sizes.parse_size(text, 1000)) == [1500000000, 0]


def test_format_sizes(values):
    given = [0, 999, 1000, 1023, 1024, 1152, 999_999, 1024**4]
    assert values(given, sizes.format_binary, "bigint") == [
        "0 B", "999 B", "1000 B", "1023 B", "1.00 KB", "1.13 KB", "976.56 KB", "1.00 TB",
    ]
    assert values(given, sizes.format_si, "bigint") == [
        "0 B", "999 B", "1.0 kB", "1.0 kB", "1.0 kB", "1.2 kB", "1000.0 kB", "1.1 TB",
    ]
    assert values([1500], lambda size: sizes.format_si(size, "K"), "bigint") == ["1.5 KB"]
    assert values([0, 5, 1500, 2 * 10**18], sizes.format_cell, "bigint") == ["", "5.0 B", "1.5 KB", "2.0 EB"]


def test_instants(values):
    given = [
        "2025-03-07T10:00:01.1Z",
        "2025-03-07T10:00:01Z",
        "2025-03-07T10:00:01.123+00:00",
        "2025-03-07T11:00:01+01",
        "2025-03-07T11:30:01+0130",
        "2025-03-07T10:00Z",
        "2025-03-07",
        "bad",
        None,
    ]
    shown = values(given, lambda text: F.date_format(times.parse_instant(text), "HH:mm:ss.SSS"))
    assert shown == [
        "10:00:01.100", "10:00:01.000", "10:00:01.123", "10:00:01.000", "10:00:01.000", "10:00:00.000", None, None, None,
    ]


def test_cycle_names(values):
    given = ["scheduled_deletion_20250415", "scheduled_deletion_20221399", "x_scheduled_deletion_20250415", "a"]
    assert [str(day) for day in values(given, times.cycle_date)] == ["2025-04-15", "None", "None", "None"]


def test_age_is_cut_to_whole_days(values):
    given = ["2025-01-01 10:00:00", "2025-01-02 09:59:59"]
    found = values(given, lambda text: times.age_days(text.cast("timestamp"), "2025-01-03 09:59:59"))
    assert found == [1, 1]


def test_templated_request_fills_long_slot_names_first(spark):
    settings = {
        KEY_TEMPLATE: f"a=${KEY_SLOT}1 b=${KEY_SLOT}10 s=${KEY_SLOT}2",
        KEY_FUNCTION: "get ",
        KEY_SLOT_COUNT: "11",
        f"{KEY_SLOT}1_TYPE": "sdate",
        f"{KEY_SLOT}1_FORMAT": "yyyy.MM.dd",
        f"{KEY_SLOT}10_TYPE": "ETIME",
        f"{KEY_SLOT}10_FORMAT": "HH:mm",
        f"{KEY_SLOT}2_TYPE": "STRING",
    }
    row = spark.range(1).select(
        requests.templated_request(
            times.instant("2025-01-02 03:04:05"),
            times.instant("2025-01-02 06:07:08"),
            F.array(F.lit("A.L"), F.lit("B.L")),
            settings,
        ).alias("text")
    ).first()
    assert row.text == 'get a=2025.01.02 b=06:07 s=`$("A.L"; "B.L")'
