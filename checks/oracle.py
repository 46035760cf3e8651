"""The registered queries in SQL, over the same tables."""

from __future__ import annotations

from checks.queries import CYCLE_MOMENTS, CYCLE_NOW, NOW
from checks.views import (
    EXCLUSION,
    HOT_MILLIS,
    HOT_SYM,
    QUOTA_LINE,
    RAW_PATH,
    RIC,
    SIZE_PATH,
    SIZE_TEXT,
    VERSION_NAME,
    VERSION_PARENT,
    WINDOW_SECONDS,
    bare_path,
    cycle_name,
    order_exclusion,
)
from stowline.fixed_values import REQUEST_TEMPLATE

SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def bare(path: str) -> str:
    return f"regexp_replace({path}, '{SCHEME}', '')"


def text2(value: str) -> str:
    return f"printf('%.2f', round({value}, 2))"


def binary(size: str) -> str:
    steps = " ".join(
        f"WHEN {size} >= {1024**power} THEN {text2(f'{size} / {1024**power}.0::DOUBLE')} || ' {unit}'"
        for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"))
    )
    return f"CASE {steps} ELSE {size} || ' B' END"


def si(size: str, kilo: str) -> str:
    steps = " ".join(
        f"WHEN {size} >= {1000**power} THEN printf('%.1f', round({size} / {1000**power}::DOUBLE, 1)) || ' {unit}B'"
        for power, unit in ((6, "E"), (5, "P"), (4, "T"), (3, "G"), (2, "M"), (1, kilo))
    )
    return f"CASE {steps} ELSE {size} || ' B' END"


def cell(size: str) -> str:
    steps = " ".join(
        f"WHEN {size} < {1000 ** (power + 1)} "
        f"THEN printf('%.1f', round({size} / {1000**power}::DOUBLE, 1)) || ' {unit}B'"
        for power, unit in enumerate(["", "K", "M", "G", "T", "P"])
    )
    return f"CASE WHEN {size} = 0 THEN '' {steps} ELSE printf('%.1f', round({size} / 1e18, 1)) || ' EB' END"


def parsed_size(text: str, base: int) -> str:
    words = f"string_split(regexp_replace(trim({text}), '\\s+', ' ', 'g'), ' ')"
    unit = f"upper({words}[2])"
    steps = " ".join(f"WHEN '{name}' THEN {float(base**power)!r}" for power, name in enumerate(["B", "KB", "MB", "GB", "TB"]))
    number = f"TRY_CAST({words}[1] AS DOUBLE)"
    return (
        f"CASE WHEN len({words}) <> 2 OR {number} * CASE {unit} {steps} END IS NULL THEN 0::HUGEINT "
        f"WHEN abs({number} * CASE {unit} {steps} END) < 1e30 THEN trunc({number} * CASE {unit} {steps} END)::HUGEINT END"
    )


def wide(value: str) -> str:
    return f"CAST({value} AS DECIMAL(38, 0))"


def total(value: str) -> str:
    return f"CAST(sum({value}) AS BIGINT)"


def joined(parts: str, first: int, last: str) -> str:
    return f"array_to_string(list_slice({parts}, {first}, {last}), '/')"


def above(path: str) -> str:
    """Text up to the last slash."""
    return f"regexp_replace({path}, '/[^/]*$', '')"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%g')"


def first_word(segment: str, words: list[str]) -> str:
    steps = " ".join(f"WHEN contains(lower({segment}), '{word}') THEN '{word}'" for word in words)
    return f"CASE {steps} END"


WORDS = ["bm", "ib", "fx", "fi", "wm", "pcc"]
MORE_WORDS = [*WORDS, "eq"]

INV = f"""inv AS (
  SELECT {bare_path("strftime(l_shipdate, '%Y%m%d')", "strftime(l_shipdate, '%Y%m')")} AS path,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS length, l_shipdate AS mtime, l_partkey
  FROM lineitem)"""
RAW = f"{INV}, raw AS (SELECT {RAW_PATH} AS path, length, mtime FROM inv)"
CLASSED = f"""{RAW}, parts AS (
  SELECT path, length, mtime, list_filter(string_split({bare('path')}, '/'), lambda x: x <> '') AS p FROM raw),
 classed AS (
  SELECT path, length, mtime, CASE WHEN len(p) < 3 THEN 'unknown' ELSE p[3] END AS top_dir,
         CASE WHEN len(p) < 4 THEN 'other' ELSE coalesce({first_word('p[4]', WORDS)}, 'other') END AS team
  FROM parts),
 chosen AS (SELECT * FROM classed WHERE top_dir IN ('model', 'alert', 'feed', 'process'))"""
OLD = f"{CLASSED}, old AS (SELECT * FROM chosen WHERE mtime < TIMESTAMP '{NOW}' - INTERVAL 1825 DAY)"
BASED = f"""{RAW}, based AS (
  SELECT string_split({bare('path')}, '/') AS p, length FROM raw),
 levels AS (SELECT p[4] AS top_level, p[5] AS second_level, length FROM based)"""
OWNED = f"{INV}, owned AS (SELECT {above('path')} AS dir, length FROM inv)"
SPREAD = f"""{OWNED}, spread AS (
  SELECT unnest(list_transform(generate_series(2, len(string_split(dir, '/'))),
           lambda k: {joined("string_split(dir, '/')", 1, 'k')})) AS path, length FROM owned),
 sizes AS (SELECT path, {total('length')} AS size_bytes FROM spread GROUP BY path)"""
LEVEL = "len(string_split(path, '/')) - 1"
EXCL = f"excl AS (SELECT {EXCLUSION} AS path FROM nation)"
HOT_TIME = (
    "CASE WHEN event_id % 3 = 0 THEN make_timestamp((1600000200000 + CASE WHEN event_id % 30 = 0 THEN 1000 "
    "ELSE event_id * {} % 300000 END) * 1000) ELSE ts END"
)
MANY = f"""many AS (
  SELECT {order_exclusion("strftime(o_orderdate, '%Y%m%d')")} AS path FROM orders
  UNION ALL SELECT path FROM inv WHERE mtime < TIMESTAMP '1996-01-01')"""


def under(table: str) -> str:
    """Test of inv.path against a small exclusion table."""
    clean = f"(SELECT rtrim(path, '/') AS closed FROM {table})"
    return f"EXISTS (SELECT 1 FROM {clean} e WHERE path = e.closed OR starts_with(path, e.closed || '/'))"


def hits(name: str, source: str, exclusions: str) -> str:
    """Paths of `source` below one of many exclusions, by spreading every path over its prefixes."""
    return f"""{name} AS (
  SELECT DISTINCT full_path FROM (
    SELECT path AS full_path, unnest(list_transform(generate_series(1, len(string_split(path, '/'))),
      lambda k: {joined("string_split(path, '/')", 1, 'k')})) AS prefix FROM (SELECT DISTINCT path FROM {source}))
  WHERE prefix IN (SELECT rtrim(path, '/') FROM {exclusions}))"""


CYCLES = f"""names AS (
  SELECT {cycle_name("strftime(o_orderdate, '%Y%m%d')", "strftime(o_orderdate, '%Y')")} AS name FROM orders),
 cycles AS (SELECT try_strptime(regexp_extract(name, '^scheduled_deletion_([0-9]{{8}})$', 1), '%Y%m%d') AS d FROM names)"""
DIRS = f"""{OWNED}, dirs AS (
  SELECT DISTINCT unnest(list_transform(generate_series(2, len(string_split(dir, '/'))),
    lambda k: {joined("string_split(dir, '/')", 1, 'k')})) AS path FROM owned)"""
VERS = f"""vers AS (SELECT DISTINCT {VERSION_PARENT} AS parent, {VERSION_NAME} AS name FROM part),
 ranked AS (
  SELECT parent, name, row_number() OVER (
    PARTITION BY parent ORDER BY CAST(string_split(name, '.') AS HUGEINT[]) DESC, name) AS place
  FROM vers WHERE regexp_full_match(name, '[0-9]+([.][0-9]+)*'))"""
SIZES = f"lines AS (SELECT {SIZE_PATH} AS path, {SIZE_TEXT} AS size FROM orders)"
QUOTA = f"""fields AS (
  SELECT line, string_split(regexp_replace(trim(line), '\\s+', ' ', 'g'), ' ') AS f
  FROM (SELECT {QUOTA_LINE} AS line FROM customer)),
 numbers AS (
  SELECT coalesce(f[8], line) AS location, TRY_CAST(f[1] AS BIGINT) AS a, TRY_CAST(f[2] AS BIGINT) AS b,
         TRY_CAST(f[3] AS BIGINT) AS c, TRY_CAST(f[4] AS BIGINT) AS d, len(f) AS n FROM fields),
 marked AS (
  SELECT *, NOT (n = 8 AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL) AS error
  FROM numbers)"""


def quota_columns(used: str) -> str:
    def percent(part: str, whole: str) -> str:
        return f"CASE WHEN error OR {whole} = 0 THEN 0.0::DOUBLE ELSE round({part} / {whole}::DOUBLE * 100, 2) + 0.0 END"

    columns = f"""location, CASE WHEN error THEN 0 ELSE a END AS ns_quota,
      CASE WHEN error THEN 0 ELSE a - b END AS ns_used, {percent('(a - b)', 'a')} AS ns_pct,
      CASE WHEN error THEN 0.0::DOUBLE ELSE round(c / {1024**4}::DOUBLE, 2) END AS space_quota_tb,
      CASE WHEN error THEN 0.0::DOUBLE ELSE round({used} / {1024**4}::DOUBLE, 2) + 0.0 END AS space_used_tb,
      {percent(used, 'c')} AS space_pct, error"""
    return f"SELECT *, ns_pct > 80 AS ns_alert, space_pct > 80 AS space_alert FROM (SELECT {columns} FROM marked)"


def interest() -> str:
    iso = "'%Y-%m-%dT%H:%M:%S.%gZ'"
    return f"""csv AS (
  SELECT event_id AS row_key, replace(trim({RIC}), '"', '') AS ric, strftime(ts, {iso}) AS start_text,
         CASE WHEN event_id % 41 = 0 THEN 'bad'
              ELSE strftime(ts + to_seconds({WINDOW_SECONDS}), {iso}) END AS end_text
  FROM events),
 interest AS (SELECT * FROM csv WHERE ric <> ''),
 wins AS (
  SELECT row_key, ric, strptime(start_text, {iso}) AS s, strptime(end_text, {iso}) AS e
  FROM interest WHERE end_text <> 'bad')"""


ALL_WINDOWS = f"""wins AS (
  SELECT event_id AS row_key, 'U' || user_id AS ric, ts AS s, ts + to_seconds({WINDOW_SECONDS}) AS e FROM events)"""
TICKS = """base AS (
  SELECT strftime(ts, '%Y-%m-%d') AS date_column, strftime(ts, '%H:%M:%S.%g') AS time_column,
         'U' || user_id AS sym, CAST(event_id AS VARCHAR) AS tick_id, CAST(value AS VARCHAR) AS price, event_type
  FROM events),
 twice AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE event_type = 'click'),
 ticks AS (SELECT * EXCLUDE (event_type), strptime(date_column || ' ' || time_column, '%Y-%m-%d %H:%M:%S.%g') AS ts
           FROM twice)"""


def packed(minutes: int, rows: int) -> str:
    """The batches by walking the rows one at a time."""
    return f"""sorted AS (SELECT row_number() OVER (ORDER BY s, row_key) - 1 AS n, ric, s, e FROM wins),
 walk AS (
  SELECT n, n AS opener, s AS low, e AS high, 1 AS held FROM sorted WHERE n = 0
  UNION ALL
  SELECT r.n,
    CASE WHEN shut THEN r.n ELSE opener END, CASE WHEN shut THEN r.s ELSE low END,
    CASE WHEN shut THEN r.e ELSE greatest(high, r.e) END, CASE WHEN shut THEN 1 ELSE held + 1 END
  FROM (SELECT w.opener, w.low, w.high, w.held, r.*,
               (greatest(w.high, r.e) - w.low > INTERVAL {minutes} MINUTE OR w.held >= {rows}) AS shut
        FROM walk w JOIN sorted r ON r.n = w.n + 1) r),
 syms AS (
  SELECT opener, ric, min(w.n) AS seen FROM walk w JOIN sorted r USING (n) GROUP BY opener, ric),
 lists AS (
  SELECT opener, list(ric ORDER BY seen) AS names, min(ric) AS first_ric FROM syms GROUP BY opener),
 batches AS (
  SELECT w.opener AS first_row, min(r.s) AS s, max(r.e) AS e, CAST(count(*) AS INTEGER) AS rows,
         any_value(names) AS names, any_value(first_ric) AS first_ric
  FROM walk w JOIN sorted r USING (n) JOIN lists USING (opener) GROUP BY w.opener)"""


def quoted(names: str) -> str:
    return f"'`$(' || array_to_string(list_transform({names}, lambda x: '\"' || x || '\"'), '; ') || ')'"


def request(start: str, end: str, names: str) -> str:
    pieces = REQUEST_TEMPLATE.split("%s")
    values = [
        f"strftime({start}, '%Y.%m.%d')",
        f"strftime({start}, '%H:%M:%S.%g')",
        f"strftime({end}, '%Y.%m.%d')",
        f"strftime({end}, '%H:%M:%S.%g')",
        quoted(names),
    ]
    text = f"'{pieces[0]}'"
    for value, piece in zip(values, pieces[1:]):
        text += f" || {value} || '{piece}'"
    return text


def batched(size: int) -> str:
    return f"""{interest()},
 names AS (SELECT ric, (row_number() OVER (ORDER BY ric) - 1) // {size} AS batch_id
           FROM (SELECT DISTINCT ric FROM interest)),
 chunks AS (SELECT batch_id, list(ric ORDER BY ric) AS names FROM names GROUP BY batch_id),
 days AS (SELECT min(CAST(start_text[1:10] AS DATE)) AS low,
                 max(CASE WHEN end_text <> 'bad' THEN CAST(end_text[1:10] AS DATE) END) AS high FROM csv)"""


DAY_END = "+ INTERVAL 1440 MINUTE - INTERVAL 1 MILLISECOND"
PATTERN_TEAM = (
    "CASE WHEN regexp_matches({0}, '(model|mdl)') THEN 'Models' "
    "WHEN regexp_matches({0}, '^f|process') THEN 'Flows' ELSE 'Other' END"
)
TREE = f"""{INV}, parts AS (
  SELECT path, mtime, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM inv),
 tree AS (
  SELECT mtime, 'top=' || CASE WHEN len(p) < 3 THEN 'unknown' ELSE p[3] END AS top,
         'team=' || CASE WHEN len(p) < 4 THEN 'other' ELSE coalesce({first_word('p[4]', WORDS)}, 'other') END AS team,
         CAST(strlen(path) + 1 AS BIGINT) AS bytes FROM parts)"""
PIVOT_SIZES = f"""{INV}, owned AS (
  SELECT string_split({above("regexp_replace(path, '^/project/abcd/', '/project/abcd/efgh/ijkl/')")}, '/') AS d, length
  FROM inv),
 kids AS (SELECT {joined('d', 1, '7')} AS path, {total('length')} AS bytes FROM owned
          WHERE len(d) >= 7 AND d[4] = 'efgh' AND d[6] IN ('model', 'alert', 'feed', 'process') GROUP BY 1),
 bases AS (SELECT unnest(['model', 'feed', 'alert', 'process']) AS top)"""


def word_team(path: str, words: list[str]) -> str:
    steps = " ".join(f"WHEN regexp_matches({path}, '\\b{word}\\b') THEN '{word}'" for word in words)
    return f"CASE {steps} ELSE 'others' END"


def pivoted(words: list[str], wrap, source: str, key: str, kind: str = "BIGINT") -> str:
    columns = ", ".join(
        f"{wrap(f'coalesce(CAST(sum(CASE WHEN team = {chr(39)}{word}{chr(39)} THEN bytes END) AS {kind}), 0)')} AS {word}"
        for word in [*words, "others"]
    )
    return f"SELECT {key} AS base_path, {columns} FROM {source} GROUP BY 1"


OLD_LISTED = f"""{INV}, {EXCL}, listing AS (
  SELECT path || CASE WHEN contains(path, '/alert/') THEN ' copy 2' ELSE '' END AS path, length, mtime, false AS is_dir FROM inv
  UNION ALL SELECT {above('path')}, 0, mtime, true FROM inv WHERE contains(path, '/model/'))"""
INVALID = "CASE WHEN size_bytes IS NULL THEN 'INVALID_PATH' ELSE {0} END"

ORACLE: dict[str, str] = {
    "usage_by_team": f"""WITH {CLASSED}, g AS (
      SELECT top_dir, team, {total('length')} AS total_size_bytes FROM chosen GROUP BY ALL)
      SELECT *, {binary('total_size_bytes')} AS size_human FROM g""",
    "old_usage_by_team": f"""WITH {OLD}, g AS (
      SELECT top_dir, team, {total('length')} AS old_size_bytes FROM old GROUP BY ALL)
      SELECT *, {binary('old_size_bytes')} AS old_size_human FROM g""",
    "old_paths_by_team": f"""WITH {OLD}, g AS (
      SELECT top_dir, team, {total('length')} AS old_size_bytes FROM old GROUP BY ALL)
      SELECT top_dir, team, path, old_size_bytes, {binary('old_size_bytes')} AS old_size_human
      FROM old JOIN g USING (top_dir, team)""",
    "old_path_lists": f"""WITH {OLD}
      SELECT top_dir, team, CAST(count(*) AS BIGINT) AS paths, min(path) AS first_path, max(path) AS last_path,
             {total('length')} AS old_size_bytes FROM old GROUP BY ALL""",
    "usage_two_level": f"""WITH {BASED}
      SELECT top_level, coalesce(second_level, '-') AS second_level, {total('length')} AS total_size_bytes FROM levels GROUP BY 1, 2""",
    "usage_top_level": f"""WITH {BASED}
      SELECT top_level, {total('length')} AS total_size_bytes FROM levels GROUP BY 1""",
    "usage_levels": f"""WITH {BASED}
      SELECT top_level, coalesce(second_level, '-') AS second_level, {total('length')} AS total_size_bytes, 2 AS level FROM levels GROUP BY 1, 2
      UNION ALL SELECT top_level, '-', {total('length')}, 1 FROM levels GROUP BY 1""",
    "dir_sizes_depth_n": f"""WITH {SPREAD}
      SELECT path, size_bytes, {si('size_bytes', 'k')} AS size_human_readable FROM sizes
      WHERE starts_with(path, '/project/abcd/') AND {LEVEL} BETWEEN 3 AND 5""",
    "all_dir_sizes": f"WITH {SPREAD} SELECT * FROM sizes",
    "listed_dir_sizes": f"""WITH {SPREAD}, {EXCL}, {MANY},
      listed AS (SELECT path FROM excl UNION ALL SELECT path FROM many)
      SELECT l.path, coalesce(size_bytes, -1) AS size_bytes, {INVALID.format("'OK'")} AS status, {INVALID.format(si('size_bytes', 'K'))} AS size
      FROM listed l LEFT JOIN sizes s ON s.path = rtrim(l.path, '/')""",
    "usage_pivot": f"""WITH {PIVOT_SIZES}, rows AS (
        SELECT {joined("string_split(path, '/')", 1, '6')} AS base, {word_team('path', ['ib', 'eq', 'ld', 'bm'])} AS team,
               bytes FROM kids
        UNION ALL SELECT '/project/abcd/efgh/ijkl/' || top, 'others', 0 FROM bases)
      {pivoted(['ib', 'eq', 'ld', 'bm'], cell, 'rows', 'base')}""",
    "usage_pivot_bytes": f"""WITH {PIVOT_SIZES}, rows AS (
        SELECT {joined("string_split(path, '/')", 1, '6')} AS base, {word_team('path', ['ib', 'bm', 'fx'])} AS team,
               bytes FROM kids
        UNION ALL SELECT '/project/abcd/efgh/ijkl/' || top, 'others', 0 FROM bases)
      {pivoted(['ib', 'bm', 'fx'], str, 'rows', 'base')}""",
    "report_pivot": f"""WITH {SIZES}, rows AS (
        SELECT {joined("string_split(path, '/')", 1, '6')} AS base, {word_team('path', ['ib', 'eq', 'ld', 'bm'])} AS team,
               {parsed_size('size', 1000)} AS bytes FROM lines
        UNION ALL SELECT '/project/abcd/efgh/ijkl/none', 'others', 0),
      large AS (SELECT base, count(*) FILTER (bytes IS NULL) AS too_large FROM rows GROUP BY base)
      SELECT p.*, too_large FROM ({pivoted(['ib', 'eq', 'ld', 'bm'], cell, 'rows', 'base', 'HUGEINT')}) p JOIN large ON base_path = base""",
    "top_report": f"""WITH {SPREAD}, tops AS (
        SELECT *, string_split(path, '/')[4] AS name FROM sizes
        WHERE starts_with(path, '/project/abcd/') AND {LEVEL} = 3)
      SELECT path, size_bytes, {PATTERN_TEAM.format('name')} AS team, {binary('size_bytes')} AS size FROM tops""",
    "top_child_report": f"""WITH {SPREAD}, t AS (
        SELECT path AS top, size_bytes AS top_bytes, string_split(path, '/')[4] AS name FROM sizes
        WHERE starts_with(path, '/project/abcd/') AND {LEVEL} = 3),
      c AS (SELECT path AS child, size_bytes AS child_bytes, {above('path')} AS top FROM sizes
        WHERE starts_with(path, '/project/abcd/') AND {LEVEL} = 4)
      SELECT top, child, child_bytes, top_bytes, count(*) OVER (PARTITION BY top) AS children, {PATTERN_TEAM.format('name')} AS team,
             {binary('top_bytes')} AS top_size, {binary('child_bytes')} AS child_size FROM t JOIN c USING (top)""",
    "team_totals": f"""WITH {SPREAD}, g AS (
        SELECT {PATTERN_TEAM.format("string_split(path, '/')[4]")} AS team, {total('size_bytes')} AS total_bytes
        FROM sizes WHERE starts_with(path, '/project/abcd/') AND {LEVEL} = 3 GROUP BY 1)
      SELECT *, {binary('total_bytes')} AS total_size FROM g""",
    "tops_with_children": f"""WITH {SPREAD}, t AS (
        SELECT path AS top, size_bytes AS top_bytes FROM sizes WHERE starts_with(path, '/project/abcd/') AND {LEVEL} = 3),
      c AS (SELECT {above('path')} AS top, count(*) AS children FROM sizes
        WHERE starts_with(path, '/project/abcd/') AND {LEVEL} = 4 GROUP BY 1)
      SELECT top, top_bytes, CAST(coalesce(children, 0) AS BIGINT) AS children FROM t LEFT JOIN c USING (top)""",
    "old_dir_summary": f"""WITH {SIZES}, split AS (
        SELECT string_split(path, '/') AS p, {parsed_size('size', 1024)} AS bytes FROM lines),
      teams AS (
        SELECT coalesce(p[6], 'unknown') AS base_dir, bytes, coalesce(list_filter(list_transform(
          list_slice(p, 7, len(p)), lambda s: {first_word('s', MORE_WORDS)}), lambda x: x IS NOT NULL)[1], 'other') AS team
        FROM split),
      g AS (
        SELECT base_dir, team, coalesce(sum(bytes), 0)::HUGEINT AS total_bytes, CAST(0 AS TINYINT) AS is_total,
               count(*) FILTER (bytes IS NULL) AS too_large FROM teams GROUP BY 1, 2
        UNION ALL SELECT NULL, team, coalesce(sum(bytes), 0)::HUGEINT, CAST(1 AS TINYINT), count(*) FILTER (bytes IS NULL) FROM teams GROUP BY team)
      SELECT * REPLACE (coalesce(base_dir, '-') AS base_dir, {wide('total_bytes')} AS total_bytes), CASE WHEN is_total = 0
          THEN team || ' size in /project/abcd/efgh/ijkl/' || base_dir || ' = ' || {binary('total_bytes')}
          ELSE team || ' size for old dirs = ' || {binary('total_bytes')} END AS line FROM g""",
    "topk_usage": f"WITH {SPREAD} SELECT * FROM sizes ORDER BY size_bytes DESC, path LIMIT 50",
    "path_distinct": f"WITH {DIRS} SELECT path FROM dirs",
    "directories_to_depth": f"""WITH {DIRS} SELECT path FROM dirs
      WHERE starts_with(path, '/project/abcd/') AND {LEVEL} BETWEEN 3 AND 4""",
    "directories_of_interest": f"""WITH {DIRS} SELECT path FROM dirs
      WHERE regexp_full_match(path, '/project/abcd/(model|alert|feed|process)/[^/]*')""",
    "entry_counts": f"""WITH {DIRS} SELECT 'dir' AS kind, count(*) AS entries FROM dirs
      UNION ALL SELECT 'file', count(*) FROM inv""",
    "url_levels": f"""WITH b AS (SELECT page_id, {bare('url')} AS bare FROM pages)
      SELECT page_id, bare, string_split(bare, '/')[2] AS level1, string_split(bare, '/')[3] AS level2,
        coalesce(string_split(bare, '/')[6], 'unknown') AS level5, coalesce(string_split(bare, '/')[10], '-') AS level9
      FROM b""",
    "path_parts": f"""WITH {INV}, p AS (
        SELECT path, string_split(path, '/') AS s, regexp_replace(string_split(path, '/')[-1], '[.]har$', '') AS core
        FROM inv)
      SELECT path, s[-1] AS name, CAST({joined('s', 1, 'len(s) - 1')} AS VARCHAR) AS parent,
        CAST(len(s) - 1 AS INTEGER) AS depth, {joined('s', 1, '3')} AS second, {joined('s', 1, '6')} AS six,
        ltrim(CASE WHEN starts_with(path, '/project/abcd/') THEN path[14:] ELSE path END, '/') AS relative,
        coalesce(nullif(regexp_extract(core, '[0-9]{{6,8}}'), ''), '-') AS digits,
        coalesce(nullif(regexp_extract(core, '[0-9]{{6,8}}'), '')[1:6], '-') AS month FROM p""",
    "path_cleaning": f"""WITH {RAW}, odd AS (
        SELECT CASE WHEN contains(path, '/model/') THEN path || '//' ELSE path END AS path FROM raw)
      SELECT path, {bare('path')} AS bare, rtrim(path, '/') AS norm,
        {bare('path')} AS based,
        CASE WHEN starts_with({bare('path')}, '/project/abcd/') THEN {bare('path')}
             ELSE '/mnt/project/abcdef' || {bare('path')} END AS mounted FROM odd""",
    "size_parse_format": f"""WITH {SIZES}, b AS (
        SELECT path, size, {parsed_size('size', 1024)} AS binary_bytes, {parsed_size('size', 1000)} AS decimal_bytes
        FROM lines)
      SELECT * REPLACE ({wide('binary_bytes')} AS binary_bytes, {wide('decimal_bytes')} AS decimal_bytes),
        binary_bytes IS NULL AS too_large, {binary('binary_bytes')} AS binary_text, {si('decimal_bytes', 'k')} AS si_text,
        {si('binary_bytes', 'K')} AS si_upper, {cell('decimal_bytes')} AS cell FROM b""",
    "classify_modes": f"""WITH {SIZES}, s AS (SELECT path, string_split(path, '/') AS p FROM lines)
      SELECT path, CASE WHEN len(p) < 4 THEN 'unknown' ELSE p[4] END AS top,
        CASE WHEN len(p) < 5 THEN 'other' ELSE coalesce({first_word('p[5]', MORE_WORDS)}, 'other') END AS team,
        coalesce({first_word('p[-1]', MORE_WORDS)}, 'other') AS by_segment,
        coalesce(list_filter(list_transform(list_slice(p, 7, len(p)), lambda s: {first_word('s', MORE_WORDS)}),
                 lambda x: x IS NOT NULL)[1], 'other') AS by_segments,
        {word_team('path', ['ib', 'eq', 'ld', 'bm'])} AS by_word,
        CASE WHEN regexp_matches(lower(path), '/x-(bm|ib)/') THEN 'First'
             WHEN regexp_matches(lower(path), 'y-(fx|fi)') THEN 'Second' ELSE 'Other' END AS by_pattern FROM s""",
    "older_than": f"""WITH {INV} SELECT path, length FROM inv
      WHERE mtime < TIMESTAMP '{NOW}' - INTERVAL 2000 DAY""",
    "before_date": f"WITH {INV} SELECT path, length FROM inv WHERE mtime < TIMESTAMP '2000-01-01'",
    "date_dirs": f"""WITH {DIRS} SELECT path FROM dirs WHERE len(list_filter(string_split(path, '/'),
      lambda p: regexp_full_match(p, '[0-9]{{8}}') AND TRY_CAST(p AS INTEGER) < 20000101)) > 0""",
    "har_before_month": f"""WITH {INV} SELECT path FROM inv WHERE ends_with(path, '.har')
      AND CAST(regexp_extract(string_split(path, '/')[-1], '[0-9]{{6}}') AS INTEGER) < 200001""",
    "markers_old": f"""WITH {INV}, aged AS (
        SELECT path, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(mtime)) / 86400) AS BIGINT) AS age_days
        FROM inv WHERE ends_with(path, '/_SUCCESS'))
      SELECT * FROM aged WHERE age_days >= 1500""",
    "prefix_anti_small": f"WITH {INV}, {EXCL} SELECT {RAW_PATH} AS path, length FROM (SELECT * FROM inv WHERE NOT {under('excl')})",
    "prefix_anti_large": f"""WITH {INV}, {MANY}, {hits('hit', 'inv', 'many')}
      SELECT {RAW_PATH} AS path, length FROM (SELECT * FROM inv WHERE path NOT IN (SELECT full_path FROM hit))""",
    "prefix_anti_nested": f"""WITH {INV}, {MANY}, {EXCL}, closed AS (SELECT path FROM many UNION ALL SELECT path FROM excl),
      hot AS (SELECT CASE WHEN length % 3 = 0 THEN '/project/abcd/feed/hot' ELSE path END AS path,
                     CASE WHEN length % 3 = 0 THEN 'hdfs://nn:8020/project/abcd/feed/hot' ELSE {RAW_PATH} END AS shown, length FROM inv),
      {hits('hit', 'hot', 'closed')}
      SELECT shown AS path, length FROM hot WHERE path NOT IN (SELECT full_path FROM hit)""",
    "latest_version": f"WITH {VERS} SELECT parent, name FROM ranked WHERE place = 1",
    "old_version_dirs": f"WITH {VERS} SELECT parent, name, parent || '/' || name AS path FROM ranked WHERE place > 1",
    "find_old_local": f"""WITH {INV}, {EXCL}, {VERS.split(', ranked AS')[0].split(chr(10) + ' ranked AS')[0].rstrip(',')},
      roots AS (SELECT DISTINCT {VERSION_PARENT} AS parent FROM part WHERE regexp_matches(p_brand, '[02468]$')),
      closed AS (SELECT path FROM excl UNION ALL SELECT '/apps/Brand#4' UNION ALL SELECT '/apps/Brand#6/'),
      files AS (
        SELECT path, mtime FROM inv UNION ALL
        SELECT {VERSION_PARENT} || CASE WHEN p_partkey % 2 = 0 THEN '/' || {VERSION_NAME} ELSE '.d' END
               || '/f' || p_partkey, TIMESTAMP '1990-01-01' FROM part),
      ranked AS (
        SELECT parent, name, row_number() OVER (
          PARTITION BY parent ORDER BY CAST(string_split(name, '.') AS HUGEINT[]) DESC, name) AS place
        FROM vers SEMI JOIN roots USING (parent) WHERE regexp_full_match(name, '[0-9]+([.][0-9]+)*')
          AND parent NOT IN ('/apps/Brand#4', '/apps/Brand#6'))
      SELECT path FROM files WHERE mtime < TIMESTAMP '{NOW}' - INTERVAL 2000 DAY AND NOT {under('closed')}
        AND NOT EXISTS (SELECT 1 FROM roots WHERE starts_with(path, parent || '/'))
      UNION ALL SELECT parent || '/' || name FROM ranked WHERE place > 1""",
    "find_old_listing": f"""WITH {OLD_LISTED} SELECT path FROM listing
      WHERE mtime < TIMESTAMP '{NOW}' - INTERVAL 2000 DAY AND NOT {under('excl')}""",
    "final_list": f"""WITH {INV}, {EXCL}, {MANY}, both_lists AS (SELECT path FROM excl UNION ALL SELECT path FROM many),
      {hits('hit', 'inv', 'both_lists')}
      SELECT DISTINCT {RAW_PATH} AS path FROM (
        SELECT * FROM inv WHERE mtime < TIMESTAMP '{NOW}' - INTERVAL 1500 DAY AND path NOT IN (SELECT full_path FROM hit))""",
    "safe_path_rows": f"""WITH {INV} SELECT path, count(*) AS lines FROM inv
      WHERE NOT regexp_matches(path, '/(model|alert|feed|process)/') GROUP BY path""",
    "merged_exclusions": f"WITH {INV}, {EXCL}, {MANY} SELECT path FROM excl UNION SELECT path FROM many",
    "cycle_dates": f"""WITH {CYCLES} SELECT strftime(d, '%Y-%m-%d') AS cycle_date, count(*) AS directories
      FROM cycles WHERE d IS NOT NULL GROUP BY 1""",
    "cycle_status": f"""WITH {CYCLES}, n AS (SELECT min(d) AS d FROM cycles WHERE d >= DATE '{CYCLE_NOW[:10]}'),
      l AS (SELECT d, CAST(floor((epoch(d) - epoch(TIMESTAMP '{CYCLE_NOW}')) / 86400.0) AS BIGINT) AS days_left FROM n)
      SELECT strftime(d, '%Y-%m-%d') AS cycle_date, days_left,
        CASE WHEN d IS NULL THEN 'schedule' WHEN days_left <= 0 THEN 'delete' ELSE 'remind' END AS phase,
        CASE WHEN d IS NULL THEN strftime(DATE '{CYCLE_NOW[:10]}' + 4, '%Y-%m-%d') ELSE '-' END AS planned_date
      FROM l""",
    "exact_lookup": f"""WITH {INV}, {MANY} SELECT DISTINCT path AS term FROM many
      WHERE path IN (SELECT path FROM inv)""",
    "quota_report": f"WITH {QUOTA} {quota_columns('d')}",
    "quota_remaining": f"WITH {QUOTA} {quota_columns('(c - d)')}",
    "tick_filter": f"""WITH {TICKS}, {interest()}
      SELECT DISTINCT date_column, time_column, sym, tick_id, price, {stamp('ts')} AS ts
      FROM ticks JOIN wins ON sym = ric AND ts BETWEEN s AND e""",
    "ticks_in_any_window": f"""WITH {TICKS}, {interest()}
      SELECT sym, count(*) AS ticks FROM ticks
      WHERE EXISTS (SELECT 1 FROM wins WHERE sym = ric AND ts BETWEEN s AND e) GROUP BY sym""",
    "interval_pairs": f"""WITH {TICKS}, {interest()}
      SELECT tick_id, sym, row_key AS window_key FROM ticks JOIN wins ON sym = ric AND ts BETWEEN s AND e""",
    "interval_pairs_hot": f"""WITH t AS (SELECT event_id AS tick_id, {HOT_SYM} AS sym, {HOT_TIME.format('7919')} AS ts FROM events),
      w AS (SELECT event_id AS row_key, {HOT_SYM} AS ric, {HOT_TIME.format('104729')} AS s, {HOT_MILLIS} AS n FROM events)
      SELECT tick_id, sym, row_key AS window_key FROM t JOIN w ON sym = ric AND ts BETWEEN s AND s + n * INTERVAL 1 MILLISECOND""",
    "covered_seconds": f"""WITH {ALL_WINDOWS}, o AS (
        SELECT ric, s, e, max(e) OVER (PARTITION BY ric ORDER BY s, row_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
        FROM wins),
      i AS (SELECT ric, s, e, sum(CASE WHEN s <= b THEN 0 ELSE 1 END) OVER (PARTITION BY ric ORDER BY s, e) AS g FROM o),
      m AS (SELECT ric, g, epoch_us(max(e)) - epoch_us(min(s)) + 1 AS w FROM i GROUP BY ric, g)
      SELECT ric AS sym, {total('w')} AS micros FROM m GROUP BY ric""",
    "dedup_subset": f"WITH {TICKS} SELECT DISTINCT date_column, time_column, sym, tick_id, price FROM ticks",
    "pack_windows_batches": f"""WITH RECURSIVE {ALL_WINDOWS}, {packed(5, 20)}
      SELECT first_row, {stamp('s')} AS start, {stamp('e')} AS "end", rows, array_to_string(names, ',') AS syms, first_ric
      FROM batches""",
    "pack_windows_by_count": f"""WITH RECURSIVE {ALL_WINDOWS}, {packed(600, 5)}
      SELECT first_row, {stamp('s')} AS start, {stamp('e')} AS "end", rows, array_to_string(names, ',') AS syms, first_ric
      FROM batches""",
    "pack_windows_wide": f"""WITH RECURSIVE {ALL_WINDOWS}, {packed(60 * 24 * 365, 100_000)}
      SELECT first_row, {stamp('s')} AS start, {stamp('e')} AS "end", rows, array_to_string(names, ',') AS syms, first_ric
      FROM batches""",
    "window_requests": f"""WITH RECURSIVE {interest()}, {packed(5, 20)}
      SELECT row_number() OVER (ORDER BY first_ric NULLS FIRST, s, first_row) - 1 AS position, first_row, rows, {request('s', 'e', 'names')} AS request FROM batches""",
    "window_requests_by_start": f"""WITH RECURSIVE {ALL_WINDOWS}, {packed(5, 20)}
      SELECT row_number() OVER (ORDER BY s, first_ric NULLS FIRST, first_row) - 1 AS position, first_row, rows, {request('s', 'e', 'names')} AS request FROM batches""",
    "sym_batches": f"WITH {batched(20)} SELECT batch_id, array_to_string(names, ',') AS syms FROM chunks",
    "slot_grid": f"""WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
      slots AS (SELECT day, CAST(day AS TIMESTAMP) + to_minutes(unnest(generate_series(0, 1439, 7))) AS s FROM days)
      SELECT CAST(day AS VARCHAR) AS day, {stamp('s')} AS start,
             {stamp("s + INTERVAL 7 MINUTE - INTERVAL 1 MILLISECOND")} AS "end" FROM slots""",
    "allday_requests": f"""WITH {batched(20)},
      first AS (SELECT CAST(arg_min(start_text[1:10], row_key) AS TIMESTAMP) AS day FROM csv),
      slots AS (SELECT day + to_minutes(unnest(generate_series(0, 1439, 240))) AS s FROM first)
      SELECT batch_id, {request('s', 's + INTERVAL 240 MINUTE - INTERVAL 1 MILLISECOND', 'names')} AS request
      FROM chunks, slots""",
    "endpoint_day_requests": f"""WITH {batched(10)},
      ends AS (SELECT 0 AS day_no, CAST(low AS TIMESTAMP) AS s FROM days
               UNION ALL SELECT 1, CAST(high AS TIMESTAMP) FROM days)
      SELECT batch_id, day_no, {request('s', f's {DAY_END}', 'names')} AS request FROM chunks, ends""",
    "all_day_requests": f"""WITH {batched(10)},
      ends AS (SELECT n AS day_no, CAST(low + CAST(n AS INTEGER) AS TIMESTAMP) AS s
               FROM (SELECT low, unnest(generate_series(0, CAST(high - low AS INTEGER))) AS n FROM days))
      SELECT batch_id, CAST(day_no AS INTEGER) AS day_no, {request('s', f's {DAY_END}', 'names')} AS request
      FROM chunks, ends""",
    "templated_requests": f"""WITH {batched(7)},
      ends AS (SELECT 0 AS day_no, CAST(low AS TIMESTAMP) AS s FROM days
               UNION ALL SELECT 1, CAST(high AS TIMESTAMP) FROM days),
      spans AS (SELECT *, s {DAY_END} AS e FROM ends)
      SELECT batch_id, day_no, 'fetch[d:' || strftime(s, '%Y.%m.%d') || ';t:' || strftime(s, '%H:%M:%S.%g')
        || ';e:' || strftime(e, '%Y.%m.%d') || ';u:' || strftime(e, '%H:%M:%S.%g') || ';s:' || {quoted('names')}
        || ';again:' || strftime(s, '%Y%m%d') || ']' AS request FROM chunks, spans""",
    "interest_range": f"""WITH {batched(20)},
      first AS (SELECT arg_min(start_text[1:10], row_key) AS day FROM csv)
      SELECT CAST(low AS VARCHAR) AS start_day, CAST(high AS VARCHAR) AS end_day, day AS first_day FROM days, first""",
    "listing_file": f"""WITH {OLD_LISTED}
      SELECT path, is_dir, length, strftime(mtime, '%Y-%m-%d %H:%M') AS mtime FROM listing""",
    "path_list_file": f"WITH {INV}, {EXCL}, {MANY} SELECT path FROM excl UNION SELECT path FROM many",
    "manifest_file": "SELECT url AS path FROM pages WHERE NOT contains(url, 'page=1') AND NOT contains(url, '/fr/')",
    "size_line_file": f"WITH {SIZES} SELECT path, size FROM lines WHERE NOT starts_with(path, '/short')",
    "quota_file": f"WITH {QUOTA} {quota_columns('d')}",
    "size_report_file": f"""WITH {SPREAD}, {EXCL}
      SELECT l.path, {INVALID.format(si('size_bytes', 'K'))} AS size
      FROM excl l LEFT JOIN sizes s ON s.path = rtrim(l.path, '/')""",
    "single_csv": f"""WITH {CLASSED}, g AS (
      SELECT top_dir, team, {total('length')} AS total_size_bytes FROM chosen GROUP BY ALL)
      SELECT *, {binary('total_size_bytes')} AS size_human FROM g""",
    "interest_file": f"""WITH {interest()}
      SELECT ric, {stamp('s')} AS start, {stamp('e')} AS "end", 2 * count(*) AS rows FROM wins GROUP BY 1, 2, 3""",
    "interest_rejects": f"WITH {interest()} SELECT * FROM interest WHERE end_text = 'bad'",
    "tick_file": f"WITH {TICKS} SELECT * REPLACE ({stamp('ts')} AS ts) FROM ticks",
    "request_file": f"""WITH RECURSIVE {ALL_WINDOWS}, {packed(5, 20)}
      SELECT row_number() OVER (ORDER BY first_ric NULLS FIRST, s, first_row) - 1 AS position, {request('s', 'e', 'names')} AS value FROM batches""",
    "live_dir_sizes": f"""WITH {TREE}, {EXCL}, sized AS (
        SELECT top || '/' || team AS path, {total('bytes')} AS size_bytes FROM tree GROUP BY 1
        UNION ALL SELECT top, {total('bytes')} FROM tree GROUP BY 1
        UNION ALL SELECT DISTINCT 'gone' || path, NULL FROM excl)
      SELECT path, coalesce(size_bytes, -1) AS size_bytes, {INVALID.format("'OK'")} AS status, {INVALID.format(si('size_bytes', 'K'))} AS size
      FROM sized""",
    "directory_size_job": f"""WITH {TREE}, sized AS (
        SELECT top || '/' || team AS path, {total('bytes')} AS size_bytes FROM tree GROUP BY 1
        UNION ALL SELECT top, {total('bytes')} FROM tree GROUP BY 1)
      SELECT *, {si('size_bytes', 'k')} AS size_human_readable FROM sized""",
    "tree_directories": f"WITH {TREE} SELECT top AS path FROM tree UNION SELECT top || '/' || team FROM tree",
    "top_directories": f"WITH {TREE} SELECT DISTINCT top AS path FROM tree",
    "pruned_tree": f"""WITH {TREE} SELECT top || '/' || team AS path, {total('bytes')} AS bytes FROM tree
      WHERE top NOT IN ('top=alert', 'top=feed', 'top=process') GROUP BY 1""",
    "binary_file_sizes": f"WITH {TREE} SELECT top || '/' || team AS path, {total('bytes')} AS bytes FROM tree GROUP BY 1",
    "delete_listed": f"""WITH {TREE}, {EXCL}, gone AS (SELECT DISTINCT path FROM excl),
      tops AS (SELECT DISTINCT top FROM tree)
      SELECT top AS path, 'Directory Would Be Deleted' AS status FROM tops WHERE regexp_matches(top, '(model|alert)$')
      UNION ALL SELECT top, 'Directory Deleted (Skip Trash)' FROM tops WHERE regexp_matches(top, '(model|alert)$')
      UNION ALL SELECT top, 'left' FROM tops WHERE NOT regexp_matches(top, '(model|alert)$')
      UNION ALL SELECT 'gone' || path, 'File Not Found' FROM gone UNION ALL SELECT 'gone' || path, 'File Not Found' FROM gone
      UNION ALL SELECT path, 'Error: outside the allowed root' FROM gone
      UNION ALL SELECT path, 'Error: outside the allowed root' FROM gone""",
    "delete_resumed": f"""WITH {TREE}, {EXCL}, runs AS (SELECT unnest(['plain', 'resumed']) AS run),
      places AS (SELECT DISTINCT top, top || '/' || team AS path FROM tree)
      SELECT run, path, CASE WHEN regexp_matches(top, '(model|alert)$') THEN 'Directory Deleted (Skip Trash)' ELSE 'left' END AS status
      FROM places CROSS JOIN runs
      UNION ALL SELECT run, 'gone' || path, 'File Not Found' FROM excl CROSS JOIN runs
      UNION ALL SELECT run, 'gone' || path, 'File Not Found' FROM excl CROSS JOIN runs
      UNION ALL SELECT run, path, 'Error: outside the allowed root' FROM (SELECT DISTINCT path FROM excl) CROSS JOIN runs""",
    "deletion_journal": f"""WITH {TREE} SELECT DISTINCT top || '/' || team AS path, 1 AS intents,
      'Directory Deleted (Skip Trash)' AS status, 1 AS attempts FROM tree WHERE regexp_matches(top, '(model|alert)$')""",
    "purge_markers": f"""WITH {TREE}, marker AS (
        SELECT top || '/' || team || '/year=' || year(mtime) || '/_SUCCESS' AS path, max(mtime) AS mtime FROM tree GROUP BY 1)
      SELECT path, CASE WHEN floor((epoch(TIMESTAMP '{NOW}') - epoch(mtime)) / 86400) >= 1700
        THEN 'File Deleted (Skip Trash)' ELSE 'left' END AS status FROM marker""",
    "path_list_repeats": f"""WITH {INV}, {EXCL}, {MANY}, lines AS (
        SELECT path FROM excl UNION ALL SELECT path FROM many UNION ALL SELECT path FROM excl)
      SELECT path, count(*) AS lines FROM lines GROUP BY path""",
    "raw_lines": f"SELECT {QUOTA_LINE} AS value FROM customer",
    "summary_lines": f"""WITH {INV} SELECT path, CASE WHEN regexp_matches(path, '/(model|alert)/') THEN 0 ELSE length END AS bytes
      FROM inv""",
    "old_files_in_listing_file": f"""WITH {OLD_LISTED} SELECT path, length FROM listing
      WHERE NOT is_dir AND mtime < TIMESTAMP '2000-01-01'""",
    "old_archives_in_listing_file": f"""WITH {OLD_LISTED} SELECT path FROM listing WHERE NOT is_dir AND ends_with(path, '.har')
      AND CAST(regexp_extract(string_split(path, '/')[-1], '[0-9]{{6}}') AS INTEGER) < 200001""",
    "dated_directories_in_listing_file": f"""WITH {OLD_LISTED} SELECT path, length FROM listing
      WHERE is_dir AND len(list_filter(string_split(path, '/'),
        lambda p: regexp_full_match(p, '[0-9]{{8}}') AND TRY_CAST(p AS INTEGER) < 20000101)) > 0""",
    "default_slot_requests": f"""WITH {batched(20)},
      first AS (SELECT CAST(arg_min(start_text[1:10], row_key) AS TIMESTAMP) AS day FROM csv),
      slots AS (SELECT day + to_minutes(unnest(generate_series(0, 1439, 5))) AS s FROM first)
      SELECT minutes, batch_id, {request('s', 's + INTERVAL 5 MINUTE - INTERVAL 1 MILLISECOND', 'names')} AS request
      FROM chunks, slots, (VALUES ('0'), ('1441'), ('none')) AS m(minutes)""",
    "cycle_phases": f"""WITH {CYCLES}, moments AS (SELECT unnest([
        {', '.join(f"TIMESTAMP '{now}'" for now in CYCLE_MOMENTS)}]) AS moment),
      n AS (SELECT moment, min(CASE WHEN d >= CAST(moment AS DATE) THEN d END) AS d FROM cycles, moments GROUP BY moment),
      l AS (SELECT moment, d, CAST(floor((epoch(d) - epoch(moment)) / 86400.0) AS BIGINT) AS days_left FROM n)
      SELECT strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, strftime(d, '%Y-%m-%d') AS cycle_date,
        CASE WHEN d IS NULL THEN 'schedule' WHEN days_left <= 0 THEN 'delete' ELSE 'remind' END AS phase,
        CASE WHEN d IS NULL THEN strftime(CAST(moment AS DATE) + 4, '%Y-%m-%d') END AS planned_date FROM l""",
    "outcome_count": f"""WITH {TREE}, {EXCL}, {MANY}, dirs AS (SELECT top FROM tree UNION SELECT top || '/' || team FROM tree)
      SELECT 'File Not Found' AS status, count(*) AS paths FROM many
      UNION ALL SELECT 'Directory Would Be Deleted', count(*) FROM dirs
      UNION ALL SELECT 'Error: outside the allowed root', count(*) FROM excl""",
}
