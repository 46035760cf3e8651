"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning of candidates, exact verification.

1. Each document's set of word shingles becomes a digest of the set, a signature of `BANDS * ROWS` minima kept
   to 8 bits each, and one hash per band of `ROWS` minima.
2. Documents with one set are one class, numbered; the class is what is compared from here on. Sets of one id are joined
   at the end.
3. Candidates share a band. First every member of a bucket meets the bucket's centre only (its class with the
   smallest number; a document meets the centres of several buckets). Links found there merge groups of near copies, however large.
4. Buckets that still hold more than one component meet their best linked member in the same way: the text that copies
   were made from is linked to all of them, though they may not be linked to each other.
5. Buckets that still hold more than one component meet in full, in blocks of bounded size inside the tasks:
   pairs within one component, with set sizes too far apart, or with an earlier band in common are skipped. The blocks'
   survivors are verified block by block on sets sent once per block, so pairs never become joined rows.
6. A candidate is compared batch by batch. After n positions with m equal, P(similarity >= threshold | m, n) under
   a uniform prior is a binomial tail; below `MISS` the pair is dropped. Survivors are verified on full sets.

A pair at the threshold shares no band with probability (1 - 0.75^4)^32 = 5e-6, less above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stowline.llm.components import components
from stowline.llm.memos import hold
from stowline.llm.tables import stored
from stowline.session import joinable

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
BATCH = 32
MISS = 1e-6
BLOCK = 512

_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_word_hashes = _WordHashes()


def _hold_words() -> None:
    """The words of this worker, not of the driver that sends the task's function."""
    hold(_word_hashes)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; with fewer words the whole sequence is the only one."""
    # bytes are lower-cased in A-Z and split at ASCII white space only
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_word_hashes) > 500_000:
        _word_hashes.clear()
    hashes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for place in range(size):
        total += hashes[place : len(words) - size + 1 + place] * _PLACES[place]
    return np.unique(_mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every permutation over a non-empty set."""
    points = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(points), 512):
        np.minimum(least, (points[at : at + 512, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return least


def _facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold_words()
        for batch in batches:
            sizes, digests, short, bands = [], [], [], []
            for text_of in batch.column(1):  # one text at a time
                shingles = shingle_set(text_of.as_py())
                sizes.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                if len(shingles):
                    least = signature(shingles)
                    short.append(((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes())
                    mixed = _mix((least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64))
                    bands.append(mixed.view(np.int64))
                else:
                    short.append(b"")
                    bands.append(np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0] + [len(one) for one in bands]), pa.int32()), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            )
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(short, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(arrays, [key, "n_shingles", "_set", "_signature", "_bands"])

    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_shingles long, _set binary, _signature binary, _bands array<long>"
    )


def least_matches(percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """After n compared positions: the fewest equal ones with which a pair may still reach the threshold.

    With a uniform prior, P(p >= t | m of n equal) = P(Binomial(n + 1, t) <= m); 8-bit minima are equal by chance once in 256.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = {}
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def plausible(left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which row pairs of two signature matrices survive; positions are compared in batches, dropped pairs no further."""
    open_ = np.arange(len(left))
    equal = np.zeros(len(left), np.int64)
    for n, m in least.items():
        part = slice(n - BATCH, n)
        equal[open_] += (left[open_, part] == right[open_, part]).sum(axis=1)
        open_ = open_[equal[open_] >= m]
    kept = np.zeros(len(left), bool)
    kept[open_] = True
    return kept


def _pruned(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) that survive the signature batches."""
    least = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (
                    np.frombuffer(b"".join(batch.column(at).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for at in (2, 3)
                )
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(plausible(left, right, least)))

    for side in "ab":
        other = signatures.select(F.col("node").alias(side), F.col("_signature").alias(f"_{side}"))
        pairs = pairs.join(other, side)
    return pairs.select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """Stored pairs whose full sets reach the threshold. Only documents of some pair are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column(2), batch.column(3)):
                one, other = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                good.append(reaches(one, other))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = _sets(docs, pairs.select("a").union(pairs.select("b")), nodes, key, text)
    for side in "ab":
        pairs = pairs.join(full.select(F.col("node").alias(side), F.col("_shingles").alias(f"_{side}")), side)
    return stored(pairs.select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long"), "links")


def reaches(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    common = int((one.take(np.searchsorted(one, other), mode="clip") == other).sum())
    return 100 * common >= PERCENT * (len(one) + len(other) - common)


def _close(one, other):
    """Sets so unlike in size cannot reach the threshold."""
    return 100 * F.least(one, other) >= PERCENT * F.greatest(one, other)


def _labelled(members: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with component and number of links, a row per bucket."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("_links"))
    degree = joinable(stored(degree, "degree"))
    labelled = members.join(found.withColumnRenamed("component", "_label"), "node", "left").join(degree, "node", "left")
    label, number = F.coalesce("_label", "node").alias("_label"), F.coalesce("_links", F.lit(0)).alias("_links")
    labelled = labelled.select("node", "n_shingles", label, number, F.explode("_met.band").alias("band"))
    mixed = labelled.groupBy("band").agg(F.count("*").alias("_n"), F.min("_label").alias("_low"), F.max("_label").alias("_high"))
    # the centre has met all others, so two members have nothing left
    mixed = mixed.filter((F.col("_n") > 2) & (F.col("_low") != F.col("_high"))).select("band")
    return labelled.join(mixed, "band", "left_semi")


def _best_linked(labelled: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's member with most links and its members in other components."""
    best = F.max(F.struct("_links", F.xxhash64("node").alias("h"), "node", "n_shingles", "_label"))
    centres = labelled.groupBy("band").agg(best.alias("_c")).filter("_c._links > 0")
    centres = centres.select("band", F.col("_c.node").alias("_centre"), F.col("_c.n_shingles").alias("_size"), F.col("_c._label").alias("_other"))
    met = labelled.join(centres, "band").filter((F.col("_label") != F.col("_other")) & _close(F.col("n_shingles"), F.col("_size")))
    return met.select(F.least("node", "_centre").alias("a"), F.greatest("node", "_centre").alias("b")).distinct()


def _rest(labelled: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell, nodes, labels, left, right): the surviving pairs, as positions in `nodes`, of every block that has some.

    Set sizes fall into classes of ratio 4/3; a pair is at most one class apart, so a row joins the group of its
    class and that of the class below. A group of more than BLOCK rows is dealt by hash into parts, and every two
    parts meet in a block of their own. A pair is taken up in the first band that it shares only.
    """
    least = least_matches()
    size_class = F.floor(F.log(F.col("n_shingles")) / math.log(100 / PERCENT))
    rows = labelled.withColumn("_own", size_class)
    rows = rows.select("band", "node", "n_shingles", "_label", "_own", F.explode(F.array("_own", F.col("_own") - 1)).alias("_class"))
    counts = rows.groupBy("band", "_class").agg(F.count("*").alias("_n"), F.max(F.col("_own") == F.col("_class")).alias("_some"))
    counts = counts.filter((F.col("_n") > 1) & F.col("_some")).withColumn("_parts", F.ceil(F.col("_n") / BLOCK)).drop("_n", "_some")
    rows = rows.join(counts, ["band", "_class"]).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts")))
    part = F.col("_part")
    blocks = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1),
        lambda other: F.struct(F.least(part, other).alias("i"), F.greatest(part, other).alias("j")),
    )
    rows = rows.withColumn("_block", F.explode(blocks)).join(nodes.select("node", "_signature", "_bands"), "node")
    member = F.struct("node", "n_shingles", "_label", (F.col("_own") == F.col("_class")).alias("_own"), "_part", "_signature", "_bands")
    groups = rows.groupBy("band", "_class", "_block").agg(F.collect_list(member).alias("_members"))  # at most about 2 * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for cell, band, i, j, members in zip(*(batch.column(at).to_pylist() for at in range(5))):
                size = np.array([member["n_shingles"] for member in members])
                own = np.array([member["_own"] for member in members])
                part_of = np.array([member["_part"] for member in members])
                _, label = np.unique([member["_label"] for member in members], return_inverse=True)
                bands = np.array([member["_bands"] for member in members])
                marks = np.frombuffer(b"".join(member["_signature"] for member in members), np.uint8).reshape(len(members), -1)
                place = int(np.flatnonzero(bands[0] == band)[0])
                left, right = [], []
                for at in range(len(members) - 1):
                    other = np.arange(at + 1, len(members))
                    near = 100 * np.minimum(size[at], size[other]) >= PERCENT * np.maximum(size[at], size[other])
                    meet = (own[at] | own[other]) & (label[at] != label[other]) & near
                    if i != j:
                        meet &= part_of[at] != part_of[other]
                    other = other[meet]
                    if len(other):
                        other = other[~(bands[at, :place] == bands[other, :place]).any(axis=1)]
                    if len(other):
                        other = other[plausible(np.broadcast_to(marks[at], (len(other), marks.shape[1])), marks[other], least)]
                        left += [at] * len(other)
                        right += other.tolist()
                if left:
                    some, where = np.unique([left, right], return_inverse=True)
                    where = where.reshape(2, -1).tolist()
                    cells.append((cell, [members[at]["node"] for at in some], [members[at]["_label"] for at in some], *where))
            columns = list(zip(*cells)) or [()] * 5
            ids = pa.list_(pa.int64())
            kinds = (pa.int64(), ids, ids, pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), ["cell", "nodes", "labels", "left", "right"])

    cell = F.xxhash64("band", "_class", "_block.i", "_block.j").alias("cell")
    return groups.select(cell, "band", "_block.i", "_block.j", "_members").mapInArrow(
        run, "cell long, nodes array<long>, labels array<long>, left array<int>, right array<int>"
    )


def _sets(docs: DataFrame, needed: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """Stored (node, _shingles) of the needed classes, each from a document of it that is read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold_words()
        for batch in batches:
            sets = [shingle_set(one.as_py()) for one in batch.column(2)]
            # another row of the id may hold another text
            good = [xxhash.xxh3_128_digest(one.tobytes()) == digest for one, digest in zip(sets, batch.column(1).to_pylist())]
            rows = pa.array([one.tobytes() for one in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["node", "_shingles"]).filter(pa.array(good, pa.bool_()))

    wanted = nodes.select("node", "_set", F.col("_first").alias(key)).join(needed.toDF("node").distinct(), "node", "left_semi")
    wanted = joinable(stored(wanted, "wanted"))  # texts are shuffled only for more classes than may be broadcast
    texts = docs.select(key, text).join(wanted, key).select("node", "_set", text)
    sets = texts.mapInArrow(run, "node long, _shingles binary").groupBy("node").agg(F.any_value("_shingles").alias("_shingles"))
    return stored(sets, "sets")


def _verified_cells(cells: DataFrame, docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """Stored links (a, b) of stored cells. Within a cell, pairs that earlier links have joined are not verified again."""
    sets = _sets(docs, cells.select(F.explode("nodes")), nodes, key, text)
    wanted = cells.select("cell", F.explode("nodes").alias("node"))
    held = wanted.join(sets, "node").groupBy("cell").agg(F.collect_list(F.struct("node", "_shingles")).alias("_held"))  # at most 2 * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for nodes, labels, left, right, sets_of in zip(*(batch.column(at).to_pylist() for at in range(5))):
                shingles = {one["node"]: np.frombuffer(one["_shingles"], np.uint64) for one in sets_of}
                root = {label: label for label in labels}

                def top(label):
                    while root[label] != label:
                        label = root[label]
                    return label

                for at, it in zip(left, right):
                    one, other = top(labels[at]), top(labels[it])
                    if one != other and reaches(shingles[nodes[at]], shingles[nodes[it]]):
                        root[other] = one
                        links.append((nodes[at], nodes[it]))
            columns = list(zip(*links)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], ["a", "b"])

    joined = cells.join(held, "cell").select("nodes", "labels", "left", "right", "_held")
    return stored(joined.mapInArrow(run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Documents without words have no shingles and are linked with nothing. Rows of one id count as one document and get
    one component. A row without an id is linked with nothing, has no component and is kept. An empty table gives no
    rows; other columns are left out. Ids are whole numbers or strings.
    """
    facts = stored(_facts(docs, key, text), "shingled")
    known = facts.filter((F.col("n_shingles") > 0) & F.col(key).isNotNull())
    classes = known.groupBy("_set").agg(
        F.min(key).alias("_first"), F.any_value(F.struct("n_shingles", "_signature", "_bands")).alias("_of")
    )
    nodes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "_set", "_first", "_of.*"), "nodes")
    signatures = nodes.select("node", "_signature")
    bands = nodes.select("node", "n_shingles", F.explode("_bands").alias("band"))
    # the least node is the centre: one for most bands of a group, so a member meets few, and what it links to is mostly final
    buckets = bands.groupBy("band").agg(F.count("*").alias("_n"), F.min(F.struct("node", "n_shingles")).alias("_centre"))
    buckets = stored(buckets.filter(F.col("_n") > 1).drop("_n"), "buckets")
    met = F.collect_list(F.struct("band", "_centre")).alias("_met")  # at most BANDS
    members = stored(bands.join(buckets, "band").groupBy("node", "n_shingles").agg(met), "members")
    pairs = members.select("node", "n_shingles", F.explode(F.array_distinct("_met._centre")).alias("_centre"))
    pairs = pairs.filter((F.col("node") != F.col("_centre.node")) & _close(F.col("n_shingles"), F.col("_centre.n_shingles")))
    pairs = pairs.select(F.col("_centre.node").alias("a"), F.col("node").alias("b"))
    links = _verified(stored(_pruned(pairs, signatures), "survivors"), docs, nodes, key, text)
    found = joinable(components(links))
    for step in ("best linked", "rest"):
        labelled = stored(_labelled(members, found, links), "mixed")
        if labelled.isEmpty():
            break
        if step == "best linked":
            survivors = stored(_pruned(_best_linked(labelled), signatures), "survivors")
            more = _verified(survivors, docs, nodes, key, text)
        else:
            more = _verified_cells(stored(_rest(labelled, nodes), "cells"), docs, nodes, key, text)
        if not more.isEmpty():
            links = links.union(more)
            found = joinable(components(_stars(found).union(more)))
    return _assigned(facts, known, nodes, found, key)


def _stars(found: DataFrame) -> DataFrame:
    """Components as edges (a, b) from each node to the smallest."""
    return found.toDF("a", "b")


def _assigned(facts: DataFrame, known: DataFrame, nodes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of `facts` with their component: the smallest id of any set that links or ids in common reach."""
    several = known.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(key)
    several = stored(several, "repeated-ids")
    if not several.isEmpty():
        of_id = known.select(key, "_set").join(several, key, "left_semi").distinct()
        ids = stored(of_id.join(nodes.select("_set", "node"), "_set").select(key, "node"), "sets-of-ids")
        first = ids.groupBy(key).agg(F.min("node").alias("b"))
        same = stored(ids.join(first, key).select(F.col("node").alias("a"), "b").filter(F.col("a") != F.col("b")), "same-id")
        if not same.isEmpty():
            found = joinable(components(_stars(found).union(same)))
    owned = nodes.select("_set", "node", "_first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = owned.groupBy("component").agg(F.min("_first").alias("_component"))
    owner = owned.join(least, "component").select("_set", "_component")
    joined = facts.select(key, "n_shingles", "_set").join(owner, "_set", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col(key))
    component = F.when(F.col(key).isNotNull(), component)
    return joined.select(key, "n_shingles", component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"))
