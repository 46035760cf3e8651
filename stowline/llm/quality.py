"""Quality rules: per-document counts, and line frequency across the documents of a host.

Lines are compared after lower-casing A-Z, turning 0-9 into 0 and joining words by single spaces; their hashes are ordered
as unsigned 64-bit numbers. Copies of a text in one host count as one text, and near copies count once by a key:

1. A line is shared when it stands in more than `line_texts` distinct texts of its host.
2. A text whose words outside shared lines are fewer than `left_share` of all has the smallest two hashes of its shared
   lines as its key, every other text is its own key. Texts that differ in a few words differ in few lines, so a group of
   them has few keys, whatever its size; texts with words of their own count one by one.
3. A line is above the limits when it stands in more than `line_texts` distinct keys of its host, and in more than
   `line_share` of them.

A document is depleted when its other lines hold less than `left_share` of its words.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stowline.llm.memos import hold
from stowline.llm.tables import stored
from stowline.session import joinable

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
LINE_TEXTS = 20
LINE_SHARE = 0.05
LEFT_SHARE = 0.2
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def _repeated_words(words: list[bytes]) -> int:
    """Words within three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(word, len(number)) for word in words], np.int64)
    # numbers stay below the count of words, so three fit into one key for texts of up to two million words
    if len(number) <= 2_000_000:
        windows = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        windows = pairs[:-1] * len(number) + ids[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = count[which] > 1
    hit = np.zeros(len(words), bool)
    for place in range(3):
        hit[place : place + len(repeated)] |= repeated
    return int(hit.sum())


def line_key(line: str) -> int:
    """64-bit hash of a normalised line, less 2^63: signed numbers in the order of the unsigned ones."""
    plain = b" ".join(line.encode().translate(_PLAIN).split())
    return int.from_bytes(hashlib.md5(plain).digest()[:8], "big") - (1 << 63)


def _measure(text: str) -> tuple:
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space only
    word_chars = len(text) - sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    repeats = 0
    lines: dict[int, int] = {}
    for line in text.split("\n"):
        size = len(line.encode().split())
        if not size:
            continue
        if line in seen:
            repeats += 1
        seen.add(line)
        key = line_key(line)
        lines[key] = lines.get(key, 0) + size
    return len(words), word_chars, symbols, repeats, _repeated_words(words), list(lines.items())


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_text", "_lines"]
_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))


def _digest(text: str) -> Column:
    """Null and empty texts are one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def measure_documents(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """The five counts of every row, with its host, a digest of its text and its distinct lines with their words."""
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key), F.coalesce(F.col(host).cast("string"), F.lit("\x00")), F.col(text), _digest(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            counts_of: list[tuple] = []
            ends, keys, sizes = [0], array("q"), array("q")
            for text_of in batch.column(2):  # one text at a time, and plain numbers for its lines
                *five, own = _measure(text_of.as_py() or "")
                counts_of.append(tuple(five))
                keys.extend(line for line, _ in own)
                sizes.extend(words for _, words in own)
                ends.append(len(keys))
            counts = [pa.array(column, pa.int64()) for column in list(zip(*counts_of)) or [()] * 5]
            pairs = pa.StructArray.from_arrays(
                [pa.array(np.array(column, np.int64)) for column in (keys, sizes)], fields=list(_LINES.value_type)
            )
            lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            arrays = [batch.column(0), batch.column(1), *counts, batch.column(3), lines]
            yield pa.RecordBatch.from_arrays(arrays, [key, "_host", *_NAMES])

    return narrow.mapInArrow(
        run,
        f"`{key}` {kind}, _host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, _text binary, _lines array<struct<line: long, words: long>>",
    )


def _exact(share: float) -> Column:
    """A share as a decimal: products with whole numbers have no rounding."""
    return F.lit(Decimal(str(share)))


def shared_lines(measured: DataFrame, line_texts: int, left_share: float) -> tuple[DataFrame, DataFrame]:
    """(stored texts with their shared lines and `_key`, distinct keys per host).

    The first holds (_host, _text, _shared, _key); texts without shared lines are left out. A text's shared lines are
    gathered in one row, as they came.
    """
    texts = measured.groupBy("_host", "_text").agg(F.any_value(F.struct("_lines", "n_words")).alias("_of"))
    lines = texts.select("_host", "_text", F.col("_of.n_words").alias("_words"), F.inline("_of._lines"))
    often = lines.groupBy("_host", "line").agg(F.count("*").alias("_in")).filter(F.col("_in") > line_texts).drop("_in")
    held = lines.join(joinable(stored(often, "often")), ["_host", "line"], "left_semi")
    gathered = held.groupBy("_host", "_text", "_words").agg(F.collect_list(F.struct("line", "words")).alias("_shared"))
    left = F.col("_words") - F.aggregate("_shared", F.lit(0).cast("long"), lambda total, one: total + one["words"])
    least = F.slice(F.sort_array(F.transform("_shared", lambda one: one["line"])), 1, 2)
    key = F.when(left < F.col("_words") * _exact(left_share), F.concat_ws(" ", least.cast("array<string>"))).otherwise(F.hex("_text"))
    found = stored(gathered.select("_host", "_text", "_shared", key.alias("_key")), "shared-lines")
    # all texts of a host, without those that share their key with another one
    per_host = measured.select("_host", "_text").distinct().groupBy("_host").agg(F.count("*").alias("_texts"))
    of_key = found.groupBy("_host", "_key").agg(F.count("*").alias("_n")).groupBy("_host").agg((F.sum("_n") - F.count("*")).alias("_less"))
    keys = per_host.join(of_key, "_host", "left").select("_host", (F.col("_texts") - F.coalesce("_less", F.lit(0))).alias("_keys"))
    return found, stored(keys, "host-keys")


def above_limits(found: DataFrame, keys: DataFrame, line_texts: int, line_share: float) -> DataFrame:
    """(_host, line) above the limits, from `shared_lines`; keys are combined before they are shuffled."""
    each = found.select("_host", "_key", F.explode("_shared.line").alias("line")).distinct()
    counts = each.groupBy("_host", "line").agg(F.count("*").alias("_in")).filter(F.col("_in") > line_texts)
    return counts.join(joinable(keys), "_host").filter(F.col("_in") > F.col("_keys") * _exact(line_share)).select("_host", "line")


def frequent_lines(
    measured: DataFrame, line_texts: int = LINE_TEXTS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE
) -> DataFrame:
    """(_host, line) above the limits."""
    return above_limits(*shared_lines(measured, line_texts, left_share), line_texts, line_share)


def judge_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    line_texts: int = LINE_TEXTS,
    line_share: float = LINE_SHARE,
    left_share: float = LEFT_SHARE,
) -> DataFrame:
    """(key, the five counts, n_frequent_words, base_failed, kept) of every row.

    Null texts have no words and fail. Null hosts form one host. Null and repeated keys pass through, a row each;
    copies of a text in one host get the same verdict. An empty table gives no rows; other columns are left out.
    """
    measured = stored(measure_documents(docs, key, text, host), "measured")
    found, keys = shared_lines(measured, line_texts, left_share)
    frequent = joinable(stored(above_limits(found, keys, line_texts, line_share), "frequent"))
    # worked out once for each text of a host, not for each copy
    lines = found.select("_host", "_text", F.inline("_shared"))
    removed = lines.join(frequent, ["_host", "line"], "left_semi").groupBy("_host", "_text").agg(F.sum("words").alias("_removed"))
    joined = measured.drop("_lines").join(joinable(stored(removed, "removed")), ["_host", "_text"], "left")
    return joined.select(
        key,
        *_NAMES[:5],
        F.coalesce("_removed", F.lit(0)).alias("n_frequent_words"),
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("n_words") - F.coalesce("_removed", F.lit(0)) >= F.col("n_words") * _exact(left_share))).alias("kept"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def without_frequent_lines(docs: DataFrame, frequent: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, text) of every row without its host's frequent lines; the other lines keep their order and form.

    The rows' line hashes are joined to the frequent lines and gathered per row, so keys must be unique.
    """
    measured = measure_documents(docs, key, text, host)
    lines = measured.select(key, "_host", F.explode("_lines.line").alias("line"))
    drop = lines.join(frequent, ["_host", "line"]).groupBy(key).agg(F.collect_set("line").alias("_drop"))
    joined = docs.select(key, F.col(text).alias("_text")).join(drop, key, "left")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for one, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if one is not None and gone:
                    gone = set(gone)
                    one = "\n".join(line for line in one.split("\n") if not line.strip(_BLANKS) or line_key(line) not in gone)
                texts.append(one)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, text])

    return joined.mapInArrow(run, f"`{key}` {kind}, `{text}` string")
