"""Path columns. All take and return Columns and stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from stowline.fixed_values import ARCHIVE_SUFFIX, EMBEDDED_DATE_PATTERN

_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _prefix(path: Column, segments: Column | int) -> Column:
    count = F.lit(segments) if isinstance(segments, int) else segments
    return F.call_function("substring_index", path, F.lit("/"), count)


def strip_scheme(path: Column | str) -> Column:
    """`hdfs://host:port/a`, `file:/a`, `file:///a` -> `/a`; bare paths skip the pattern."""
    path = _col(path)
    return F.when(path.startswith("/"), path).otherwise(F.regexp_replace(path, _SCHEME, ""))


def normalize(path: Column | str) -> Column:
    """Cut trailing slashes; any run of slashes alone is the root."""
    path = _col(path)
    cut = F.rtrim(path, F.lit("/"))
    trimmed = F.when(cut == "", F.lit("/")).otherwise(cut)
    return F.when(path.endswith("/"), trimmed).otherwise(path)


def identity(path: Column | str) -> Column:
    """What two spellings of one path share: no scheme, host or trailing slash. Used wherever a path protects another."""
    return normalize(strip_scheme(path))


def depth(path: Column | str) -> Column:
    """Number of components of a normalized absolute path; the root has none."""
    path = _col(path)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.when(path == "/", F.lit(0)).otherwise(slashes)


def ancestor(path: Column | str, level: Column | int) -> Column:
    """The first `level` components of an absolute path, all of a shorter one."""
    return _prefix(_col(path), level + 1)


def ancestors(path: Column | str, first: int = 1, last: Column | int | None = None) -> Column:
    """Array of the path's prefixes from `first` components up to `last` (default: the path itself)."""
    path = _col(path)
    own = depth(path)
    end = own if last is None else F.least(own, F.lit(last) if isinstance(last, int) else last)
    levels = F.when(end >= first, F.sequence(F.lit(first), end)).otherwise(F.array().cast("array<int>"))
    return F.transform(levels, lambda level: ancestor(path, level))


def file_name(path: Column | str) -> Column:
    return _prefix(_col(path), -1)


def parent(path: Column | str) -> Column:
    path = _col(path)
    cut = F.left(path, F.length(path) - F.length(file_name(path)) - 1)
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def is_under(path: Column | str, base: str) -> Column:
    """Equal to `base` or below it, tested at a component boundary."""
    path = _col(path)
    return (path == base) | path.startswith(base.rstrip("/") + "/")


def rebase(path: Column | str, base: str) -> Column:
    """Cut everything before the first occurrence of `base` that ends at a component boundary."""
    bare = strip_scheme(path)
    pattern = "^.*?(" + re.escape(base) + "(/.*)?)$"
    return F.when(is_under(bare, base), bare).otherwise(F.regexp_replace(bare, pattern, "$1"))


def relative_to(path: Column | str, base: str) -> Column:
    path = _col(path)
    rest = F.when(is_under(path, base), F.substr(path, F.lit(len(base.rstrip("/")) + 1))).otherwise(path)
    return F.ltrim(rest, F.lit("/"))


def component(path: Column | str, index: int, default: str | None = None) -> Column:
    """Piece `index` of the path split at `/` (piece 0 is the empty text before the first slash)."""
    piece = F.get(F.split(_col(path), "/"), F.lit(index))
    return piece if default is None else F.coalesce(piece, F.lit(default))


def leading_pieces(path: Column | str, count: int) -> Column:
    """The first `count` `/`-separated pieces, joined again."""
    return _prefix(_col(path), count)


def embedded_date(path: Column | str) -> Column:
    """First run of 6 to 8 digits in an archive's base name, NULL when there is none."""
    name = file_name(path)
    core = F.regexp_replace(name, re.escape(ARCHIVE_SUFFIX) + "$", "")
    digits = F.regexp_extract(core, EMBEDDED_DATE_PATTERN, 1)
    return F.when(digits != "", digits)


def embedded_month(path: Column | str) -> Column:
    return F.left(embedded_date(path), F.lit(6))
