"""How filters act together: what each removes at every place of every order, from one walk over all subsets.

1. Each document becomes a mask of the filters it fails; one pass measures the texts, the copies are found by a digest.
2. Documents are counted by part and mask (with how many are good and toxic among them): 32 cells a part at most.
3. Each part's subsets of filters are walked in Gray code order, so one filter is switched at a time. Every cell keeps the
   number of switched-on filters it fails; when that number leaves or reaches zero the cell leaves or joins the running
   survivors. The survivors of all 32 subsets are stored.
4. A filter's removals at a step of an order are the difference of two stored states, as are the Shapley sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stowline.llm.tables import stored
from stowline.session import joinable

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SYMBOLS = "#$%&*|"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COPY = 1 << FILTERS.index("E")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_mask(text: str | None) -> int:
    """Bits of the filters A to D that the text fails."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    mask = int(len(words) < MIN_WORDS)
    mask |= (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
    mask |= (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > CAPITAL_PERCENT * len(text)) << 2
    mask |= any(symbol in text for symbol in SYMBOLS) << 3
    return mask


def failure_masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Stored (key, part, mask) of every row: the filters it fails, bit 0 for A to bit 4 for E.

    E compares with all rows of the table. Null texts are empty, and so copies of each other; null parts are the empty
    one. A row without a key fails E never, and makes no other row fail it; rows of one key do not make each other fail.
    """
    kind = docs.schema[key].dataType.simpleString()
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    narrow = docs.select(F.col(key), F.coalesce(F.col(part).cast("string"), F.lit("")), digest, F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = pa.array([text_mask(one) for one in batch.column(3).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], masks], ["_key", "part", "_text", "_mask"])

    facts = stored(narrow.mapInArrow(run, f"_key {kind}, part string, _text binary, _mask int"), "mask-facts")
    # copies are combined before the shuffle; only texts of several keys go on
    first = facts.groupBy("_text").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"))
    first = stored(first.filter(F.col("_first") < F.col("_last")).select("_text", "_first"), "first-copies")
    copy = F.when(F.col("_key") > F.col("_first"), F.lit(_COPY)).otherwise(F.lit(0))
    masked = facts.join(joinable(first), "_text", "left")
    return stored(masked.select(F.col("_key").alias(key), "part", (F.col("_mask") + copy).alias("mask")), "masks")


def mask_cells(masks: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and mask, how many are labelled good and how many toxic.

    A key counts as good or toxic if any label row of it says so. Rows are combined by key before the labels are joined,
    so neither repeated keys nor repeated label rows gather in one task.
    """
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(
        F.coalesce(F.max((F.col(good) == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col(toxic) == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    marks = marks.filter("good = 1 OR toxic = 1")
    rows = masks.groupBy(F.col(key).alias("_id"), "part", "mask").agg(F.count("*").alias("n"))
    joined = rows.join(marks, "_id", "left")
    total = lambda name: F.coalesce(F.sum(F.when(F.col(name) == 1, F.col("n"))), F.lit(0))
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good").alias("good"), total("toxic").alias("toxic"))


def gray_states(cells: list[tuple[int, tuple]], filters: int = len(FILTERS)) -> list[tuple]:
    """Survivors of every subset of filters, added up over the cells (mask, counts) that fail none of them."""
    width = len(cells[0][1]) if cells else 0
    running = [sum(counts[at] for _, counts in cells) for at in range(width)]
    failing = [0] * len(cells)
    states: list[tuple] = [()] * (1 << filters)
    states[0] = tuple(running)
    subset = 0
    for step in range(1, 1 << filters):
        bit = step & -step  # the one filter in which two neighbours of the Gray code differ
        subset ^= bit
        change = 1 if subset & bit else -1
        for at, (mask, counts) in enumerate(cells):
            if not mask & bit:
                continue
            failing[at] += change
            if failing[at] == (change > 0):  # joined or left the survivors just now
                for place, count in enumerate(counts):
                    running[place] -= change * count
        states[subset] = tuple(running)
    return states


def audit(cells: list[tuple[int, tuple]], filters: str = FILTERS) -> list[tuple]:
    """(order, step, the seven counts) for all orders of the filters; counts of a cell are (rows, good, toxic)."""
    size = len(filters)
    states = gray_states(cells, size)
    failing = [sum(counts[0] for mask, counts in cells if mask >> at & 1) for at in range(size)]
    alone = [sum(counts[0] for mask, counts in cells if mask == 1 << at) for at in range(size)]
    shapley = [0] * size
    for subset, state in enumerate(states):
        before = subset.bit_count()
        for at in range(size):
            if not subset >> at & 1:
                orders = math.factorial(before) * math.factorial(size - 1 - before)
                shapley[at] += orders * (state[0] - states[subset | 1 << at][0])
    out = []
    for order in permutations(range(size)):
        subset, name = 0, "".join(filters[at] for at in order)
        for step, at in enumerate(order, 1):
            before, after = states[subset], states[subset | 1 << at]
            removed, good, toxic = (one - other for one, other in zip(before, after))
            out.append((name, step, after[0], removed, failing[at] - removed, alone[at], good, toxic, shapley[at]))
            subset |= 1 << at
    return out


def audit_parts(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, the seven counts) of every part of `mask_cells`. A part's cells are 32 at most."""
    cell = F.struct("mask", "n", "good", "toxic")
    parts = cells.groupBy("part").agg(F.collect_list(cell).alias("_cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "filter_order", "step", *COUNTS]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
        for batch in batches:
            for part, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = audit([(one["mask"], (one["n"], one["good"], one["toxic"])) for one in members])
                columns = [[part] * len(rows), *zip(*rows)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), names)

    counts = ", ".join(f"{name} long" for name in COUNTS)
    return parts.mapInArrow(run, f"part string, filter_order string, step int, {counts}")


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    A table without rows has no parts and gives none; labels of keys without documents count for nothing, documents
    without labels are neither good nor toxic. Other columns of both tables are left out.
    """
    return audit_parts(mask_cells(failure_masks(docs, key, text, part), labels, key))
