"""Shards by a k-d tree over document metadata, cut at distributed weighted medians.

Every node is cut along its widest metadata dimension (the width as a share of the whole table's) where
half of its bytes lie on either side, until the leaves reach the target bytes. Rows at the cut are
told apart by a number of their own, so a value that many rows share does not stop the cut from being even. All nodes
of a level are cut together. A median is found by histograms of BINS bins within the range that still
holds it: sums per (node, bin), never rows, reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stowline.llm.tables import stored
from stowline.operators.numbering import number_rows

BINS = 4096


@dataclass
class _Cut:
    """The search for one node's cut: first along `dimension`, then among equal values along the tie key."""

    node: int
    dimension: int
    half: float
    low: int
    high: int
    below: int = 0  # bytes of the node's rows before the range
    value: int | None = None  # the settled value of the dimension, once the search goes on along the tie key
    done: bool = False


def _either(default: Column, of_node: dict[int, Column]) -> Column:
    out = default
    for node, column in of_node.items():
        out = F.when(F.col("_node") == node, column).otherwise(out)
    return out


def _bin(distance: Column, step: int) -> Column:
    """Whole-number division; the multiple of the step has a small quotient, which doubles hold exactly."""
    return F.round((distance - F.pmod(distance, F.lit(step))) / F.lit(step)).cast("long")


def _level(rows: DataFrame, names: list[str], tie: str, size: str, nodes: list[int], spans: list[int]) -> dict[int, tuple]:
    """node -> (dimension name, value, tie value): rows up to and including that point go left."""
    facts = rows.filter(F.col("_node").isin(nodes)).groupBy("_node").agg(
        F.sum(size).alias("bytes"),
        *(one(F.col(name)).alias(f"{kind}{at}") for at, name in enumerate([*names, tie]) for kind, one in (("low", F.min), ("high", F.max))),
    )
    ties, cuts = {}, []
    for fact in facts.collect():  # one row per node
        widths = [(fact[f"high{at}"] - fact[f"low{at}"]) / max(1, spans[at]) for at in range(len(names))]
        at = max(range(len(names)), key=lambda one: (widths[one], -one))
        ties[fact["_node"]] = (fact[f"low{len(names)}"], fact[f"high{len(names)}"])
        cuts.append(_Cut(fact["_node"], at, fact["bytes"] / 2, fact[f"low{at}"], fact[f"high{at}"]))
    while open_cuts := [cut for cut in cuts if not cut.done]:
        steps = {cut.node: max(1, -(-(cut.high - cut.low + 1) // BINS)) for cut in open_cuts}
        value = {
            cut.node: F.col(names[cut.dimension]) if cut.value is None else F.when(F.col(names[cut.dimension]) == cut.value, F.col(tie))
            for cut in open_cuts
        }
        inside = _either(F.lit(None).cast("long"), {cut.node: F.when(value[cut.node].between(cut.low, cut.high), _bin(value[cut.node] - F.lit(cut.low), steps[cut.node])) for cut in open_cuts})
        sums = rows.withColumn("_bin", inside).filter(F.col("_bin").isNotNull()).groupBy("_node", "_bin").agg(F.sum(size).alias("bytes"))
        histogram: dict[int, dict[int, int]] = {}
        for row in sums.collect():  # at most nodes * BINS rows
            histogram.setdefault(row["_node"], {})[row["_bin"]] = row["bytes"]
        for cut in open_cuts:
            step = steps[cut.node]
            for number, weight in sorted(histogram[cut.node].items()):
                if cut.below + weight >= cut.half:
                    break
                cut.below += weight
            low = cut.low + number * step
            cut.low, cut.high = low, min(cut.high, low + step - 1)
            if cut.low == cut.high:
                if cut.value is None:
                    cut.value = cut.low
                    cut.low, cut.high = ties[cut.node]
                else:
                    # the last key goes to the side that it leaves nearer to half
                    goes_left = cut.half - cut.below >= weight / 2
                    cut.low -= not goes_left
                    cut.done = True
    return {cut.node: (names[cut.dimension], cut.value, cut.low) for cut in cuts}


def assign_shards(rows: DataFrame, names: list[str], tie: str, size: str, shards: int) -> DataFrame:
    """Adds `shard` (0 to shards - 1) to a stored table. `names`, `tie` and `size` are whole-number columns without nulls.

    `shards` is a power of two. An empty table stays empty; rows that agree in all dimensions and the tie stay together.
    """
    depth = int(math.log2(shards))
    if 1 << depth != shards:
        raise ValueError("the number of shards must be a power of two")
    first = rows.agg(*(F.max(name) - F.min(name) for name in names)).first()
    placed = rows.withColumn("_node", F.lit(0))
    if first[0] is None:
        return placed.withColumnRenamed("_node", "shard")
    for level in range(depth):
        cuts = _level(placed, names, tie, size, list(range(1 << level)), list(first))
        right = {node: (F.col(name) > value) | ((F.col(name) == value) & (F.col(tie) > key)) for node, (name, value, key) in cuts.items()}
        placed = placed.withColumn("_node", F.col("_node") * 2 + _either(F.lit(False), right).cast("int"))
    return placed.withColumnRenamed("_node", "shard")


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", length: str = "n_chars", source: str = "source", lang: str = "lang") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row: shards of near equal bytes, slots gapless from 0.

    The dimensions are the key, the text's bytes, the length column, and the source and language as hashes. Null texts
    have no bytes (size 1, crc of nothing); nulls in other columns count as -1. Rows are numbered as
    they are stored, so repeated keys are cut apart like others, and keys may be any 64-bit numbers. An empty table gives no rows; other columns are left out.
    """
    octets = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    code = lambda name: F.coalesce(F.pmod(F.xxhash64(name), F.lit(1 << 16)), F.lit(-1)).cast("long")
    facts = docs.select(
        F.col(key),
        (octets + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftright(F.coalesce(F.col(key).cast("long"), F.lit(-1)), 1).alias("_key"),  # distances of any two fit 64 bits
        F.monotonically_increasing_id().alias("_row"),
        F.coalesce(F.col(length).cast("long"), F.lit(-1)).alias("_length"),
        F.when(F.col(source).isNull(), -1).otherwise(code(source)).cast("long").alias("_source"),
        F.when(F.col(lang).isNull(), -1).otherwise(code(lang)).cast("long").alias("_lang"),
    )
    rows = stored(facts, "shard-facts")
    placed = assign_shards(rows, ["_key", "size", "_length", "_source", "_lang"], "_row", "size", shards)
    numbered = number_rows(placed.select(key, "size", "text_crc32", "shard", "_row"), ["shard", key, "_row"], "_number")
    counts = numbered.groupBy("shard").agg(F.min("_number").alias("_first"))  # one row per shard
    return numbered.join(F.broadcast(counts), "shard").select(
        key, "size", "text_crc32", "shard", (F.col("_number") - F.col("_first")).alias("slot")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, folder: str, key: str = "doc_id") -> None:
    """Write whole documents by shard, a folder each, in slot order within a file. Keys must be unique."""
    placed = docs.join(assigned.select(key, "shard", "slot"), key)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
