"""Sums over whole subtrees in path order: every directory is shuffled a fixed number of times, however deep it lies."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from stowline.functions.paths import depth
from stowline.operators.prefix import order_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUT_ROWS = 16_384


class _OpenDirectories:
    """The directories that the current path lies below, each with the bytes met so far."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.totals: list[int | None] = []
        self.done: list[tuple[str, int | None]] = []

    def meet(self, path: str, total: int | None) -> None:
        """Close what `path` does not lie below, open what is new on the way to it, and count its bytes there."""
        while self.paths and not (path == self.paths[-1] or path.startswith(self.paths[-1] + "/")):
            self.close()
        if not self.paths or path != self.paths[-1]:
            # an ancestor ends before each slash beyond the one already open, or beyond the first component
            known = len(self.paths[-1]) if self.paths else path.find("/")
            cut = path.find("/", known + 1)
            while cut >= 0:
                self._open(path[:cut])
                cut = path.find("/", cut + 1)
            self._open(path)
        self._count(total)

    def close(self) -> None:
        path, total = self.paths.pop(), self.totals.pop()
        self.done.append((path, total))
        if self.paths:
            self._count(total)

    def _open(self, path: str) -> None:
        self.paths.append(path)
        self.totals.append(None)

    def _count(self, total: int | None) -> None:
        if total is not None:
            self.totals[-1] = (self.totals[-1] or 0) + total

    def taken(self) -> pa.RecordBatch:
        paths, totals = [row[0] for row in self.done], [row[1] for row in self.done]
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(totals, pa.int64())], ["path", "_bytes"])


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened = _OpenDirectories()
    for batch in batches:
        for path, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            opened.meet(path, total)
            if len(opened.done) >= OUT_ROWS:
                yield opened.taken()
    while opened.paths:
        opened.close()
    yield opened.taken()


def subtree_parts(own: DataFrame) -> DataFrame:
    """(path, _bytes): one row per directory and ancestor, and one more for each further partition that a subtree spans.

    `own` holds (_dir, _bytes) with normalized directories. A subtree is a contiguous range of the path order, so the
    pass over a partition holds the directories above the current one and nothing else. NULL and root directories have
    no components and give nothing; unknown bytes count as SQL sums count NULL.
    """
    keyed = own.filter(depth("_dir") > 0).select("_dir", "_bytes").withColumn("_order", order_key(F.col("_dir")))
    placed = keyed.repartitionByRange("_order").sortWithinPartitions("_order").select("_dir", "_bytes")
    return placed.mapInArrow(_partial_sums, "path string, _bytes bigint")
