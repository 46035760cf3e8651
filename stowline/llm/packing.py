"""Packing documents into sequences of one capacity.

Lengths are whole numbers up to the capacity, so the instance is its histogram, of bounded size: Spark
counts it, `plan_bins` solves it, and Spark deals the pieces, numbered by length, to the planned places.
No task and no driver step ever holds the pieces themselves.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stowline.llm.chunks import id_encoder
from stowline.llm.memos import hold
from stowline.llm.tables import stored
from stowline.operators.numbering import number_rows

Bin = tuple[tuple[int, int], ...]  # (length, items of it), in their order


def _fix_dominating(left: dict[int, int], capacity: int) -> list[tuple[int, Bin]]:
    """Martello-Toth reduction: fix sets no other set with the same longest item can beat; `left` shrinks.

    For an item j: alone if nothing fits beside it; with a partner that fills the bin; with its largest
    partner k if no two items that fit together exceed k; with k and the next largest b if no three fit
    and every other pair is covered by (k, b). Copies of one set are fixed together, since taking items
    away leaves fewer rivals.
    """
    fixed: list[tuple[int, Bin]] = []
    sizes = sorted(size for size, count in left.items() if count)

    def largest(limit: int, used: tuple[int, ...]) -> int:
        """The largest length up to the limit that has a copy besides the used ones; 0 if none."""
        at = bisect_right(sizes, limit) - 1
        while at >= 0 and left[sizes[at]] <= used.count(sizes[at]):
            at -= 1
        return sizes[at] if at >= 0 else 0

    def smallest(n: int, used: int) -> list[int]:
        out: list[int] = []
        for size in sizes:
            out += [size] * min(n - len(out), left[size] - (size == used))
            if len(out) == n:
                break
        return out

    def best_pair(limit: int, used: int) -> int:
        """The largest sum of two items within the limit; 0 if none."""
        usable = [size for size in sizes[: bisect_right(sizes, limit)] if left[size] > (size == used)]
        low, high, best = 0, len(usable) - 1, 0
        while low <= high:
            total = usable[low] + usable[high]
            if total > limit:
                high -= 1
            else:
                if low < high or left[usable[low]] - (usable[low] == used) > 1:
                    best = max(best, total)
                low += 1
        return best

    def fix(*lengths: int) -> None:
        copies = min(left[size] // lengths.count(size) for size in lengths)
        fixed.append((copies, tuple((size, lengths.count(size)) for size in dict.fromkeys(lengths))))
        for size in lengths:
            left[size] -= copies
        for size in set(lengths):
            if not left[size]:
                sizes.remove(size)

    # pairs that fill a bin first: no later step can use their room better
    for size in sorted(left, reverse=True):
        if size == capacity and left[size]:
            fix(size)
        elif left[size] and left.get(capacity - size, 0) >= 1 + (2 * size == capacity):
            fix(size, capacity - size)
    for size in sorted(left, reverse=True):
        while left[size]:
            room = capacity - size
            partner = largest(room, (size,))
            if not partner:
                fix(size)
                continue
            few = smallest(3, size)
            pair_fits = len(few) > 1 and few[0] + few[1] <= room
            triple_fits = len(few) > 2 and sum(few) <= room
            if not pair_fits or (not triple_fits and best_pair(room, size) <= partner):
                fix(size, partner)
                continue
            third = largest(room - partner, (size, partner))
            if triple_fits or not third or third < largest(room // 2, (size,)):
                break
            fix(size, partner, third)
    return fixed


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, Bin]]:
    """Best fit, longest first, on counts: bins with equal contents move together."""
    open_bins: dict[int, list[tuple[int, Bin]]] = defaultdict(list)
    for size in sorted((size for size, count in left.items() if count), reverse=True):
        count = left[size]
        moved: list[tuple[int, int, Bin]] = []
        for room in sorted(room for room in open_bins if room >= size):
            groups, each = open_bins.pop(room), room // size
            while groups and count:
                bins, contents = groups.pop()
                filled = min(bins, count // each)
                count -= filled * each
                if filled:
                    moved.append((room - each * size, filled, contents + ((size, each),)))
                if filled < bins and count:
                    moved.append((room - count * size, 1, contents + ((size, count),)))
                    filled, count = filled + 1, 0
                if filled < bins:
                    groups.append((bins - filled, contents))
            if groups:
                open_bins[room] = groups
            if not count:
                break
        each = capacity // size
        for bins, items in ((count // each, each), (1, count % each)):
            if bins and items:
                moved.append((capacity - items * size, bins, ((size, items),)))
        for room, bins, contents in moved:
            open_bins[room].append((bins, contents))
    return [group for groups in open_bins.values() for group in groups]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, Bin]]:
    """(bins, contents) groups that hold every counted item, each bin within the capacity."""
    left = {size: count for size, count in counts.items() if count}
    fixed = _fix_dominating(left, capacity)
    return fixed + _best_fit(left, capacity)


def cut_documents(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, key: str, text: str) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's pieces.

    Only documents beyond the capacity are cut; all their pieces but the first are full.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = id_encoder(tokenizer_file), end_id.to_bytes(4, "little")
        hold(encoder.memo)
        for batch in batches:
            owner: list[int] = []
            rows: list[tuple[int, int, int, int]] = []
            for at, ids in enumerate(encoder.encode_all(batch.column(1).to_pylist())):
                ids += end
                size = len(ids) // 4
                begin, piece = 0, 0
                while begin < size:
                    length = (size - begin - 1) % capacity + 1 if piece == 0 else capacity
                    owner.append(at)
                    rows.append((piece, begin, length, zlib.crc32(ids[4 * begin : 4 * (begin + length)])))
                    begin, piece = begin + length, piece + 1
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int32())), *map(pa.array, columns, kinds)],
                [key, "piece", "start", "length", "ids_crc32"],
            )

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(key, text).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """Adds `sequence_id` and `offset` to a stored table of pieces with lengths from 1 to the capacity."""
    counts = {row[0]: row[1] for row in pieces.groupBy(length).count().collect()}  # one row per length
    first, at = {}, 0
    for size in sorted(counts):
        first[size], at = at, at + counts[size]
    places: list[tuple[int, int, int, int, int]] = []  # first number, first sequence, items a bin, offset, length
    sequence = 0
    for bins, contents in plan_bins(counts, capacity):
        offset = 0
        for size, items in contents:
            places.append((first[size], sequence, items, offset, size))
            first[size] += bins * items
            offset += items * size
        sequence += bins
    table = np.array(sorted(places), np.int64).reshape(-1, 5)
    numbered = number_rows(pieces, [length, *order], "_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(batch.num_columns - 1).to_numpy()
            row = table[np.searchsorted(table[:, 0], number, "right") - 1]
            nth = number - row[:, 0]
            arrays = [*batch.columns[:-1], pa.array(row[:, 1] + nth // row[:, 2]), pa.array(row[:, 3] + nth % row[:, 2] * row[:, 4])]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "sequence_id", "offset"])

    shown = numbered.select(*pieces.columns, "_number")
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in pieces.schema)
    return shown.mapInArrow(run, f"{columns}, sequence_id long, offset long")


def pack(
    docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of `docs`.

    A document's tokens are its ids and one end id, so a null or empty text is a piece of one token. Null
    and repeated keys are packed like others, one document each; other columns are left out. An empty
    table gives no rows.
    """
    pieces = stored(cut_documents(docs, tokenizer_file, end_id, capacity, key, text), "pieces")
    return place(pieces, capacity, [key, "piece"])
