"""Ordered keyword and pattern rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stowline.functions.staging import once


def first_match(text: Column, rules: Sequence[tuple[str, str]], mode: str = "substring") -> Column:
    """Label of the first rule, in list order, that fits `text`; NULL when none does.

    Modes: `substring` (plain containment), `word` (between word boundaries), `regex`.
    """
    tests = {
        "substring": lambda pattern: text.contains(pattern),
        "word": lambda pattern: text.rlike(f"\\b{pattern}\\b"),
        "regex": lambda pattern: text.rlike(pattern),
    }
    return F.coalesce(*[F.when(tests[mode](pattern), F.lit(label)) for label, pattern in rules])


def keyword_in(segment: Column, keywords: Sequence[str], default: str = "other") -> Column:
    """Plain containment; the caller lowers the segment."""
    return F.coalesce(first_match(segment, [(word, word) for word in keywords]), F.lit(default))


def word_in(path: Column, words: Sequence[str], default: str = "others") -> Column:
    return F.coalesce(first_match(path, [(word, word) for word in words], "word"), F.lit(default))


def pattern_in(name: Column, patterns: Sequence[tuple[str, str]], default: str = "Other") -> Column:
    """The caller lowers the name."""
    return F.coalesce(first_match(name, patterns, "regex"), F.lit(default))


def keyword_in_segments(pieces: Column, after: int, keywords: Sequence[str], default: str = "other") -> Column:
    """First segment past index `after` that holds a keyword decides; inside it keyword order decides."""
    rules = [(word, word) for word in keywords]
    tail = F.transform(F.slice(pieces, F.lit(after + 2), F.size(pieces)), F.lower)
    hits = F.filter(F.transform(tail, lambda segment: first_match(segment, rules)), lambda hit: hit.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(default))


# components three and four after an optional scheme and host; possessive, so a scheme never counts as a component
_TOP_AND_SEGMENT = (
    "^(?:[A-Za-z][A-Za-z0-9+.-]*+:(?://[^/]*+)?+)?+/*+[^/]++/++[^/]++/++([^/]++)(?:/++([^/]++))?+"
)


def with_top_and_team(df: DataFrame, keywords: Sequence[str], path: str = "path") -> DataFrame:
    """Add `top_dir` (third component) and `team` (from the fourth).

    Shorter paths give ("unknown", "other").
    """
    found = once(
        df,
        _top=F.regexp_extract(path, _TOP_AND_SEGMENT, 1),
        _segment=F.lower(F.regexp_extract(path, _TOP_AND_SEGMENT, 2)),
    )
    top = F.when(F.col("_top") == "", F.lit("unknown")).otherwise(F.col("_top"))
    return found.withColumns({"top_dir": top, "team": keyword_in(F.col("_segment"), keywords)}).drop("_top", "_segment")
