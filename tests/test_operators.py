import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stowline.operators import intervals, prefix
from stowline.operators.directories import all_directory_sizes, directory_sizes, listed_sizes, tops_and_children
from stowline.operators.grid import day_slots, interval_minutes, symbol_batches
from stowline.operators.intervals import covered_ranges, drop_repeats, interval_join, ticks_in_windows
from stowline.operators.numbering import number_rows
from stowline.operators.packing import pack_windows
from stowline.operators.versions import latest_versions, old_versions, version_directories
from stowline.sources.inventory import inventory_from_rows

BASE = datetime(2025, 3, 7, 10)


def fold(rows, span, most):
    """The batches by the plain sequential walk."""
    groups, held = [], []
    for row in sorted(rows, key=lambda row: (row[1], row[3])):
        trial = [*held, row]
        length = max(r[2] for r in trial) - min(r[1] for r in trial)
        if held and (length > span or len(trial) > most):
            groups.append(held)
            trial = [row]
        held = trial
    return groups + ([held] if held else [])


def shape(groups):
    return sorted(
        (g[0][1], max(r[2] for r in g), len(g), list(dict.fromkeys(r[0] for r in g)), min(r[0] for r in g)) for g in groups
    )


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_the_sequential_walk(spark, monkeypatch, seed):
    from stowline.operators import packing

    # short chains, so that the composition has several levels
    monkeypatch.setattr(packing, "BLOCKS_PER_CHAIN", 3)
    rng = random.Random(seed)
    count = [1, 7, 60, 333, 500, 800][seed]
    most, minutes = rng.choice([1, 2, 5, 20]), rng.choice([1, 5, 30])
    gap = rng.choice([0, 5, 60])
    rows = []
    for key in range(count):
        # a third of all rows start at the same instant
        start = BASE if rng.random() < 0.34 else BASE + timedelta(seconds=rng.randint(0, gap * count // 4 + 1))
        rows.append((f"S{rng.randint(0, 9)}", start, start + timedelta(seconds=rng.randint(0, 400)), key))
    df = spark.createDataFrame(rows, "ric string, start timestamp, end timestamp, row_key bigint").repartition(5)
    packed = pack_windows(df, max_minutes=minutes, max_rows=most, block_rows=max(most, 8)).collect()
    found = sorted((r.start, r.end, r.rows, list(r.syms), r.first_ric) for r in packed)
    assert found == shape(fold(rows, timedelta(minutes=minutes), most))


@pytest.mark.parametrize("most, minutes, gap", [(1_000, 1, 1), (100_000, 10_000_000, 30), (40, 10_000_000, 1), (700, 3, 0)])
def test_packing_with_many_rows_a_batch(spark, monkeypatch, most, minutes, gap):
    from stowline.operators import packing

    monkeypatch.setattr(packing, "BLOCKS_PER_CHAIN", 3)
    rng = random.Random(most)
    rows = []
    for key in range(3_000):
        start = BASE + timedelta(seconds=rng.randint(0, gap * 900))
        # a few windows are far longer than the others
        length = rng.randint(0, 20) if rng.random() < 0.99 else rng.randint(0, 4_000)
        rows.append((f"S{rng.randint(0, 9)}", start, start + timedelta(seconds=length), key))
    df = spark.createDataFrame(rows, "ric string, start timestamp, end timestamp, row_key bigint").repartition(5)
    packed = pack_windows(df, max_minutes=minutes, max_rows=most, block_rows=64).collect()
    found = sorted((r.start, r.end, r.rows, list(r.syms), r.first_ric) for r in packed)
    assert found == shape(fold(rows, timedelta(minutes=minutes), most))


def test_exit_tables_give_every_exit_back():
    import numpy as np
    from types import SimpleNamespace

    from stowline.operators.packing import _exit, _pieces

    for seed in range(200):
        rng = np.random.default_rng(seed)
        exits = np.cumsum(rng.choice([0, 1, 5, -3], size=rng.integers(1, 40), p=[0.45, 0.45, 0.05, 0.05])) + 200
        table = SimpleNamespace(**dict(zip(("begins", "exits", "slopes"), _pieces(exits))))
        assert _exit(table, np.arange(len(exits))).tolist() == exits.tolist()
        assert [int(_exit(table, at)) for at in range(len(exits))] == exits.tolist()
    assert len(_pieces(np.arange(100_000) + 7)[0]) == 1 and len(_pieces(np.zeros(100_000, dtype=int))[0]) == 1


def test_packing_of_nothing(spark):
    empty = spark.createDataFrame([], "ric string, start timestamp, end timestamp, row_key bigint")
    assert pack_windows(empty).count() == 0


def test_a_window_longer_than_the_span_stands_alone(spark):
    rows = [("A", BASE, BASE + timedelta(hours=1), 0), ("B", BASE, BASE + timedelta(seconds=1), 1)]
    df = spark.createDataFrame(rows, "ric string, start timestamp, end timestamp, row_key bigint")
    assert sorted(tuple(r.syms) for r in pack_windows(df).collect()) == [("A",), ("B",)]


def test_row_numbers_are_dense_and_ordered(spark):
    rows = [(7 if n % 3 else n, n) for n in range(3000)]
    df = spark.createDataFrame(rows, "v int, k int").repartition(6)
    found = number_rows(df, ["v", "k"]).orderBy("row_no").collect()
    assert [(r.v, r.k) for r in found] == sorted(rows)
    assert [r.row_no for r in found] == list(range(3000))


def excluded(path, closed):
    def norm(text):
        return text.rstrip("/") or "/"

    here = norm(path)
    for one in map(norm, closed):
        if here == one or here.startswith(one + "/") or (one == "/" and here.startswith("/")):
            return True
    return False


CLOSED = ["/a/b", "/a/d/", "  /x/y/z ", "rel/p", "hdfs://nn/q", "", "/a/b/c"]
PATHS = [
    "/a/b", "/a/b/", "/a/bc", "/a/b/c/d", "/a/d", "/a/d/e", "/a", "/x/y", "/x/y/z", "/x/y/z/1/2", "rel/p/q", "rel", "hdfs://nn/q/r",
    "hdfs://nn/qr", "/",
]


def test_prefix_forms_agree_with_brute_force(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string")
    closed = spark.createDataFrame([(c,) for c in CLOSED], "path string")
    wanted = sorted(p for p in PATHS if not excluded(p, [c.strip() for c in CLOSED if c.strip()]))
    keys = prefix.exclusion_keys(closed)
    depths, none = prefix.split_depths(keys)
    assert none == []
    small = prefix.anti_join_by_depth(rows, keys, depths)
    large = prefix.anti_join_by_order(rows, keys)
    assert sorted(r.path for r in small.collect()) == wanted
    assert sorted(r.path for r in large.collect()) == wanted


@pytest.mark.parametrize("root", ["/", "//"])
def test_the_root_excludes_every_absolute_path(spark, root):
    rows = spark.createDataFrame([("/a",), ("/",), ("b/c",), ("/a/b/c",)], "path string")
    closed = spark.createDataFrame([(root,)], "path string")
    assert [r.path for r in prefix.exclude_below(rows, closed).collect()] == ["b/c"]
    keys = prefix.exclusion_keys(closed)
    assert [r.path for r in prefix.anti_join_by_order(rows, keys).collect()] == ["b/c"]


def test_too_many_exclusions_take_the_other_form(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BROADCAST_ROWS", 2)
    closed = spark.createDataFrame([(c,) for c in CLOSED], "path string")
    small, large = prefix.split_depths(prefix.exclusion_keys(closed))
    assert small and large
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string")
    found = prefix.exclude_below(rows, closed)
    assert "BroadcastNestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.path for r in found.collect()) == sorted(
        p for p in PATHS if not excluded(p, [c.strip() for c in CLOSED if c.strip()])
    )


def test_merging_in_path_order(spark):
    """Against brute force over many partitions, with nested and hot paths, odd characters and nulls."""
    rng = random.Random(2)
    parts = ["a", "b", "ab", "a b", "a-", "a\x01", "\x00", "é", "a.b"]
    make = lambda most: "/" + "/".join(rng.choices(parts, k=rng.randint(1, most)))
    paths = [make(6) for _ in range(1500)] + ["/a/b/ab"] * 700 + [None, "/", "a/b", "hdfs://nn:1/a/b/é"]
    closed = [make(5) for _ in range(60)] + ["/a/b", "/a/b/ab/"]
    rows = spark.createDataFrame(list(enumerate(paths)), "n int, path string").repartition(4)
    keys = prefix.exclusion_keys(spark.createDataFrame([(one,) for one in closed], "path string"))
    bare = lambda path: path[path.index("/", 7):] if path.startswith("hdfs:") else path
    wanted = [at for at, path in enumerate(paths) if path is None or not excluded(bare(path), closed)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(row.n for row in prefix.anti_join_by_order(rows, keys).collect()) == wanted
        plan = prefix.in_path_order(rows, keys)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_exclusions_keep_everything(spark):
    rows = spark.createDataFrame([("/a",)], "path string")
    assert prefix.exclude_below(rows, spark.createDataFrame([], "path string")).count() == 1


@pytest.fixture
def tree(spark):
    return inventory_from_rows(
        spark,
        [
            ("/p/m", True, 0, BASE),
            ("/p/m/a", True, 0, BASE),
            ("/p/m/a/f1", False, 10, BASE),
            ("hdfs://nn/p/m/a/b/f2", False, 5, BASE),
            ("/p/m/f3", False, 1, BASE),
            ("/p/f4", False, 100, BASE),
            ("/p/empty", True, 0, BASE),
            ("/pq/f5", False, 7, BASE),
        ],
    )


def test_directory_sizes(tree):
    assert {(r.path, r.size_bytes) for r in directory_sizes(tree, "/p", 1).collect()} == {("/p/m", 16), ("/p/empty", 0)}
    assert {(r.path, r.size_bytes) for r in directory_sizes(tree, "/p", 3).collect()} == {
        ("/p/m", 16), ("/p/empty", 0), ("/p/m/a", 15), ("/p/m/a/b", 5),
    }
    assert directory_sizes(tree, "/p", 0).count() == 0
    assert {(r.path, r.size_bytes) for r in all_directory_sizes(tree).collect()} >= {("/p", 116), ("/pq", 7)}


def test_subtree_sums_of_deep_trees(spark):
    from stowline.operators.subtrees import subtree_parts

    rng = random.Random(5)
    own, names = {}, ["a", "a!", "a-b", "ab", "\x01", "\u00e9", "b"]
    deep = "".join(f"/d{level}" for level in range(40))
    for _ in range(600):
        # a third of all directories lie far below one chain
        above = deep if rng.random() < 0.34 else ""
        own["".join([above, *(f"/{rng.choice(names)}" for _ in range(rng.randint(1, 8)))])] = rng.choice([None, 0, 3, 2**40])
    own["/a//b"], own[deep], own["/"], own[None] = 5, 7, 11, 13
    wanted = {}
    for path, size in own.items():
        pieces = (path or "").split("/")
        for level in range(2, len(pieces) + 1) if path != "/" else ():
            at = "/".join(pieces[:level])
            if size is None:
                wanted.setdefault(at, None)
            else:
                wanted[at] = (wanted.get(at) or 0) + size
    df = spark.createDataFrame(list(own.items()), "_dir string, _bytes bigint").repartition(7)
    parts = subtree_parts(df).collect()
    found = {}
    for path, size in parts:
        found[path] = size if found.get(path) is None else found[path] + (size or 0)
    assert found == wanted
    # rows follow the directories; only those open at a partition's end come again
    assert len(parts) <= len(wanted) + 8 * 49
    assert subtree_parts(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_listed_sizes_keep_repeats_and_mark_unknown(spark, monkeypatch, tree, few):
    from stowline.operators import directories

    monkeypatch.setattr(directories, "is_small", lambda side: few)
    listed = spark.createDataFrame([("/p/m/",), ("/p/m/",), ("/none",), ("/p/empty",)], "path string")
    found = sorted((r.path, r.size_bytes, r.status) for r in listed_sizes(tree, listed).fillna(-1).collect())
    assert found == [("/none", -1, "INVALID_PATH"), ("/p/empty", 0, "OK"), ("/p/m/", 16, "OK"), ("/p/m/", 16, "OK")]


def test_tops_and_children(tree):
    tops, children = tops_and_children(tree, "/p")
    assert {(r.top, r.top_bytes, r.children) for r in tops.collect()} == {("/p/m", 16, 1), ("/p/empty", 0, 0)}
    assert {(r.top, r.child, r.child_bytes) for r in children.collect()} == {("/p/m", "/p/m/a", 15)}


def test_versions(spark):
    names = ["1", "1.0", "1.0.1", "0.1", "1.9", "1.10", "v2", "2x"]
    rows = [(f"/apps/a/{name}", True, 0, BASE) for name in names] + [
        ("/apps/b/01.0", True, 0, BASE), ("/apps/b/1.0", True, 0, BASE), ("/apps/a/9.9", False, 0, BASE),
    ]
    found = version_directories(inventory_from_rows(spark, rows))
    assert {(r.parent, r["name"]) for r in latest_versions(found).collect()} == {("/apps/a", "1.10"), ("/apps/b", "01.0")}
    assert {r.path for r in old_versions(found).collect()} == {
        f"/apps/a/{name}" for name in ["1", "1.0", "1.0.1", "0.1", "1.9"]
    } | {"/apps/b/1.0"}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_ticks_in_windows_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(intervals, "BROADCAST_RANGES", limit)
    rng = random.Random(3)
    symbol = lambda: "HOT" if rng.random() < 0.4 else f"S{rng.randint(0, 5)}"
    windows = []
    for key in range(120):
        start = BASE + timedelta(milliseconds=rng.randint(0, 3_600_000))
        windows.append((key, symbol(), start, start + timedelta(milliseconds=rng.choice([-5, 0, 1, 5000, 400_000, 1_300_000]))))
    windows += [windows[0]] * 40
    ticks = [(n, symbol(), BASE + timedelta(milliseconds=rng.randint(0, 4_000_000))) for n in range(1500)]
    ticks += [(5000 + n, w[1], w[2 + n % 2]) for n, w in enumerate(windows[:60])] + [(9999, "HOT", None)]
    w = spark.createDataFrame(windows, "row_key int, ric string, start timestamp, end timestamp")
    t = spark.createDataFrame(ticks + ticks[:50], "tick_id int, sym string, ts timestamp")
    inside = lambda tick, win: tick[2] and tick[1] == win[1] and win[2] <= tick[2] <= win[3]
    kept = sorted(tick[0] for tick in ticks + ticks[:50] if any(inside(tick, win) for win in windows))
    for seconds in (60, 300, 7200):
        assert sorted(r.tick_id for r in ticks_in_windows(t, w, seconds).collect()) == kept
    pairs = sorted((tick[0], win[0]) for tick in ticks + ticks[:50] for win in windows if inside(tick, win))
    assert sorted((r.tick_id, r.row_key) for r in interval_join(t, w).collect()) == pairs
    once = drop_repeats(ticks_in_windows(t, w))
    assert sorted(r.tick_id for r in once.collect()) == sorted(set(kept))


def test_hot_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(intervals, "HOT_PAIRS", 200)
    monkeypatch.setattr(intervals, "CUTS", 8)
    rng = random.Random(4)
    at = lambda: BASE + timedelta(milliseconds=rng.choice([5000, rng.randrange(290_000), rng.randrange(40)]))
    ticks = [("H", at(), n) for n in range(400)] + [("A", at(), n) for n in range(400, 405)] + [(None, at(), 405), ("H", None, 406)]
    windows = []
    for n in range(200):
        start = at()
        windows.append(("H" if n % 4 else "A", start, start + timedelta(milliseconds=rng.choice([0, 1, 50, 100_000, 9_000_000])), n))
    windows.append((None, BASE, BASE + timedelta(days=1), 200))
    pairs = intervals.interval_join(
        spark.createDataFrame(ticks, "sym string, ts timestamp, n int"),
        spark.createDataFrame(windows, "ric string, start timestamp, end timestamp, k int"),
    )
    wanted = sorted((n, k) for sym, ts, n in ticks for ric, start, end, k in windows if sym and ts and sym == ric and start <= ts <= end)
    assert sorted((row.n, row.k) for row in pairs.collect()) == wanted
    assert pairs.columns == ["sym", "ts", "n", "ric", "start", "end", "k"]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_one_instant_is_dealt_out(spark, monkeypatch, limit):
    """Ticks and windows of one instant meet in blocks, none of which holds all their pairs."""
    monkeypatch.setattr(intervals, "BROADCAST_RANGES", limit)
    monkeypatch.setattr(intervals, "HOT_PAIRS", 400)
    monkeypatch.setattr(intervals, "CUTS", 8)
    ticks = [("H", BASE, n) for n in range(130)] + [("H", BASE + timedelta(seconds=n), 200 + n) for n in range(90)]
    windows = [("H", BASE - timedelta(seconds=n % 3), BASE + timedelta(seconds=n % 5), n) for n in range(110)]
    windows += windows[:7]
    t = spark.createDataFrame(ticks, "sym string, ts timestamp, n int")
    w = spark.createDataFrame(windows, "ric string, start timestamp, end timestamp, k int")
    wanted = sorted((n, k) for _, ts, n in ticks for _, start, end, k in windows if start <= ts <= end)
    assert sorted((row.n, row.k) for row in intervals.interval_join(t, w).collect()) == wanted


def test_blocks_bound_the_pairs_of_one_piece(spark, monkeypatch):
    monkeypatch.setattr(intervals, "HOT_PAIRS", 100)
    cut = spark.range(95).selectExpr("'H' AS _sym", "id AS n", "CASE WHEN id < 90 THEN 0 ELSE 1 END AS _piece")
    held = spark.range(43).selectExpr("'H' AS _sym", "id AS k", "CASE WHEN id < 40 THEN 0 ELSE 1 END AS _piece")
    keys = ["_sym", "_piece"]
    met = [one.join(other, [*keys, "_block"]) for one, other in [intervals._dealt(cut, held, keys)]][0].collect()
    pairs = [(row.n, row.k) for row in met]
    assert len(pairs) == len(set(pairs)) == 90 * 40 + 5 * 3
    blocks = {}
    for row in met:
        blocks[row["_piece"], row["_block"]] = blocks.get((row["_piece"], row["_block"]), 0) + 1
    assert len(blocks) == 9 * 4 + 1 and max(blocks.values()) <= 2 * 100


def test_rows_at_even_steps_fill_all_places(spark, monkeypatch):
    monkeypatch.setattr(intervals, "HOT_PAIRS", 100)
    cut = spark.range(0, 1000, 1, 1).selectExpr("id AS n", "CASE WHEN id % 10 = 3 THEN 0 ELSE id + 5000 END AS _piece")
    held = spark.range(0, 500, 1, 1).selectExpr("id AS k", "CASE WHEN id % 5 = 4 THEN 0 ELSE id + 1000 END AS _piece")
    ticks, windows = intervals._dealt(cut, held, ["_piece"])
    met = ticks.join(windows, ["_piece", "_block"]).select("n", "k", "_block").collect()
    assert len(met) == len({(row.n, row.k) for row in met}) == 100 * 100
    sizes = Counter(row["_block"] for row in met)
    assert len(sizes) > 80 and max(sizes.values()) <= 4 * 100


@pytest.mark.parametrize("limit", [500_000, 0])
def test_packs_of_windows(spark, monkeypatch, limit):
    """Pieces that many windows hold whole are met pack by pack, others as before, each pair once."""
    monkeypatch.setattr(intervals, "BROADCAST_RANGES", limit)
    monkeypatch.setattr(intervals, "HOT_PAIRS", 100)
    monkeypatch.setattr(intervals, "CUTS", 8)
    monkeypatch.setattr(intervals, "PACK", 4)
    rng = random.Random(11)
    ticks = [("H", BASE + timedelta(seconds=5), n) for n in range(70)] + [("H", BASE + timedelta(milliseconds=rng.randrange(250_000)), 100 + n) for n in range(90)]
    ticks += ticks[:9] + [("H", None, 300), (None, BASE, 301), ("A", BASE, 302)]
    windows = [("H", BASE + timedelta(seconds=5 - n % 2), BASE + timedelta(seconds=5 + n % 3), n) for n in range(60)]
    windows += [("H", BASE + timedelta(milliseconds=m), BASE + timedelta(milliseconds=m + rng.choice([0, 900, 90_000])), 100 + n) for n, m in enumerate(rng.sample(range(250_000), 40))]
    windows += windows[:5] + [(None, BASE, BASE + timedelta(days=1), 300), ("A", BASE, BASE, 301), ("H", BASE, None, 302)]
    t = spark.createDataFrame(ticks, "sym string, ts timestamp, n int")
    w = spark.createDataFrame(windows, "ric string, start timestamp, end timestamp, k int")
    wanted = [(*tick, *win) for tick in ticks for win in windows if tick[0] and tick[1] and win[2] and tick[0] == win[0] and win[1] <= tick[1] <= win[2]]
    pairs = intervals.interval_join(t, w)
    assert sorted(tuple(row) for row in pairs.collect()) == sorted(wanted)
    assert pairs.columns == ["sym", "ts", "n", "ric", "start", "end", "k"]
    assert "_windows" in pairs._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [500_000, 0])
def test_pairs_of_one_instant_are_written_small(spark, monkeypatch, tmp_path, limit):
    monkeypatch.setattr(intervals, "BROADCAST_RANGES", limit)
    at = "timestamp_seconds(1600000000)"
    t = spark.range(0, 600, 1, 3).selectExpr("'H' AS sym", f"{at} AS ts", "id * 30 AS n")
    w = spark.range(0, 10_000, 1, 3).selectExpr("'H' AS ric", f"{at} AS start", f"{at} AS end", "id * 7919 % 300000 AS k")
    interval_join(t, w).select("n", "sym", "k").write.parquet(str(tmp_path / "pairs"))
    found = spark.read.parquet(str(tmp_path / "pairs"))
    assert found.count() == found.distinct().count() == 600 * 10_000
    assert sum(part.stat().st_size for part in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * 600 * 10_000


def test_covered_ranges_do_not_overlap(spark):
    rows = [("A", BASE, BASE + timedelta(minutes=12)), ("A", BASE + timedelta(minutes=1), BASE + timedelta(minutes=2))]
    rows += [("A", BASE + timedelta(minutes=11), BASE + timedelta(minutes=13))]
    found = covered_ranges(spark.createDataFrame(rows, "ric string, start timestamp, end timestamp"))
    ranges = sorted((r["from"], r["to"]) for r in found.collect())
    assert len(ranges) == 2 and ranges[0][1] < ranges[1][0]
    assert sum(high - low + 1 for low, high in ranges) == 13 * 60 * 1_000_000 + 1


@pytest.mark.parametrize("limit", [500_000, 0])
def test_windows_of_any_length(spark, monkeypatch, limit):
    monkeypatch.setattr(intervals, "BROADCAST_RANGES", limit)
    rng = random.Random(8)
    lengths = [timedelta(0), timedelta(seconds=300), timedelta(hours=5), timedelta(days=40), timedelta(days=3660)]
    windows = [(n, f"S{n % 3}", BASE + timedelta(hours=rng.randint(0, 30_000)), rng.choice(lengths)) for n in range(60)]
    windows = [(n, name, start, start + length) for n, name, start, length in windows]
    windows += [(60, "S9", BASE, datetime(9999, 12, 31)), (61, "S9", datetime(1970, 1, 1), datetime(1970, 1, 1)), (62, None, BASE, BASE)]
    ticks = [(n, f"S{rng.choice([0, 1, 2, 9])}", BASE + timedelta(minutes=rng.randint(-90_000, 7_000_000))) for n in range(800)]
    ticks += [(800 + n, w[1], w[2 + n % 2]) for n, w in enumerate(windows)] + [(1000, "S9", BASE - timedelta(microseconds=1))]
    w = spark.createDataFrame(windows, "row_key int, ric string, start timestamp, end timestamp")
    t = spark.createDataFrame(ticks, "tick_id int, sym string, ts timestamp")
    inside = lambda tick, win: tick[1] is not None and tick[1] == win[1] and win[2] <= tick[2] <= win[3]
    kept = sorted(tick[0] for tick in ticks if any(inside(tick, win) for win in windows))
    assert sorted(r.tick_id for r in ticks_in_windows(t, w).collect()) == kept
    pairs = sorted((tick[0], win[0]) for tick in ticks for win in windows if inside(tick, win))
    assert sorted((r.tick_id, r.row_key) for r in interval_join(t, w).collect()) == pairs
    assert intervals._sliced(intervals._bounded(w), 300).groupBy("row_key").count().agg(F.max("count")).first()[0] <= 2
    nothing = w.limit(0)
    assert ticks_in_windows(t, nothing).count() == 0 and interval_join(t, nothing).count() == 0


def test_symbol_batches_and_slots(spark):
    names = [(f"S{n:03d}",) for n in range(45)] * 3 + [("",), (None,)]
    found = symbol_batches(spark.createDataFrame(names, "ric string"), 20).orderBy("batch_id").collect()
    assert [len(r.syms) for r in found] == [20, 20, 5]
    assert sum((list(r.syms) for r in found), []) == [f"S{n:03d}" for n in range(45)]
    day = spark.range(1).select(F.lit("2025-03-07").cast("date").alias("day"))
    slots = day_slots(day, F.col("day"), 7).orderBy("start").collect()
    assert len(slots) == 206
    assert slots[0].end == datetime(2025, 3, 7, 0, 6, 59, 999000)
    assert slots[-1].end == datetime(2025, 3, 8, 0, 1, 59, 999000)
    assert [interval_minutes(v, 5) for v in (None, 0, 1, 1440, 1441)] == [5, 5, 1, 1440, 5]
