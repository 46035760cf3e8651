"""Runs of repeated words: maximal stretches of words with a smallest period that fits in at least twice.

A dictionary of basic factors names every stretch of 1, 2, 4, ... words, equal stretches alike. A run of period q starts
where its first L words (L the power of two with L <= q < 2L) occur again q words later, so occurrences of one name less
than 2L apart propose all periods. Occurrences at most L/2 apart form arithmetic progressions, whose difference is a
period of the stretch itself. Inside a progression the word before is the same, so a run can only start at its first
member, or meet a later progression's first member: every member proposes a bounded number of periods. A proposal is a
square when the names of its first and its last L words are repeated as well; squares are extended to the right. A
stretch proposed with several periods keeps the smallest.

Texts are handled in groups of about GROUP_WORDS words inside the tasks, long ones alone; positions whose stretch is the
only one of its name are left out of the longer names. Documents never meet, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SHORTEST = 12
GROUP_WORDS = 200_000
_AFTER = 4  # first members of later progressions that can lie less than two lengths ahead


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode().split() if text else []


def repeated_tail(key: object, n: int) -> np.ndarray | None:
    """For a tenth of the keys, by checksum: which word stands at each place once the tail repeats its beginning."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places >= a, a + (places - a) % p, places)


def _names(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name of every place, places whose name occurs again in the same document); other places are named -1."""
    return _named(owner.astype(np.int64) * (int(codes.max()) + 1) + codes, np.arange(len(codes)), len(codes))


def _named(keys: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count[name] > 1
    out = np.full(size, -1, np.int64)
    out[places[again]] = name[again]
    return out, places[again]


def _proposals(name: np.ndarray, places: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of one name, `length` to less than twice as far apart, that a run may start at."""
    order = np.argsort(name[places], kind="stable")
    at = places[order]
    same = np.zeros(len(at), bool)  # of one name with the place before
    same[1:] = name[at[1:]] == name[at[:-1]]
    inside = same.copy()
    inside[1:] &= at[1:] - at[:-1] <= length // 2
    firsts = np.flatnonzero(~inside)
    cluster = np.cumsum(~inside) - 1
    name_of_first = name[at[firsts]]
    later = np.flatnonzero(inside)
    for step in range(1, _AFTER + 1):
        # any place with the first member of a later progression
        to = cluster + step
        fits = np.flatnonzero(to < len(firsts))
        fits = fits[name_of_first[to[fits]] == name[at[fits]]]
        yield at[fits], at[firsts[to[fits]]]
        # a first member with the other members of a later progression
        back = cluster[later] - step
        fits = later[back >= 0]
        back = back[back >= 0]
        good = name_of_first[back] == name[at[fits]]
        yield at[firsts[back[good]]], at[fits[good]]


def _run_end(codes: np.ndarray, start: int, period: int, stop: int) -> int:
    """Where the word stops to equal the one a period before; looked for in steps that double."""
    at, step = start + period, 64
    while at < stop:
        upto = min(stop, at + step)
        other = codes[at:upto] != codes[at - period : upto - period]
        if other.any():
            return at + int(other.argmax())
        at, step = upto, step * 2
    return stop


def find_runs(codes: np.ndarray, owner: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period.

    `codes` are word numbers, `owner` the document of each place (ascending), `stop` the end of each place's document.
    """
    if not len(codes):
        return []
    found: dict[tuple[int, int], int] = {}
    name, places = _names(codes, owner)
    length = 1
    while len(places):
        for one, other in _proposals(name, places, length):
            period = other - one
            good = (period >= length) & (period < 2 * length) & (one + 2 * period <= stop[one])
            one, other, period = one[good], other[good], period[good]
            before = np.maximum(one - 1, 0)
            good = (one == 0) | (owner[before] != owner[one]) | (codes[before] != codes[other - 1])
            good &= name[one + period - length] == name[other + period - length]
            good &= name[one + period - length] >= 0
            one, period = one[good], period[good]
            # short periods need more than two rounds
            good = one + SHORTEST <= stop[one]
            one, period = one[good], period[good]
            for place in range(length, SHORTEST - 1):
                rest = place + period < SHORTEST
                if not rest.any():
                    break
                good = ~rest
                good[rest] = codes[one[rest] + place] == codes[one[rest] + place + period[rest]]
                one, period = one[good], period[good]
            for start, size in zip(one.tolist(), period.tolist()):
                end = _run_end(codes, start, size, int(stop[start]))
                if end - start >= SHORTEST and size < found.get((start, end), end):
                    found[start, end] = size
        ahead = places[places + 2 * length <= stop[places]]
        ahead = ahead[name[ahead + length] >= 0]
        keys = name[ahead] * (int(name.max()) + 1) + name[ahead + length]
        name, places = _named(keys, ahead, len(codes))
        length *= 2
    return sorted((start, end - start, size) for (start, end), size in found.items())


def _facts(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The counts, the longest run and the digests of one document; runs are numbered from its first word."""
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in sorted(runs, key=lambda run: (run[0], run[2])))
    longest = min(runs, key=lambda run: (-run[1], run[0], run[2])) if runs else None
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
        words = [words[at] for at in kept.tolist()]
    collapsed = b" ".join(words)
    shown = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    return len(runs), *shown, listed, collapsed


def _groups(keys: list, texts: list) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(row, words) in groups of about GROUP_WORDS words."""
    group, size = [], 0
    for row, (key, text) in enumerate(zip(keys, texts)):
        words = words_of(text)
        tail = repeated_tail(key, len(words))
        if tail is not None:
            words = [words[at] for at in tail.tolist()]
        group.append((row, words))
        size += len(words)
        if size >= GROUP_WORDS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _of_group(group: list[tuple[int, list[bytes]]]) -> Iterator[tuple]:
    number: dict[bytes, int] = {}
    sizes = [len(words) for _, words in group]
    codes = np.fromiter((number.setdefault(word, len(number)) for _, words in group for word in words), np.int64, sum(sizes))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(group)), sizes)
    runs: dict[int, list] = {}
    for start, length, period in find_runs(codes, owner, np.repeat(ends, sizes)):
        of = int(owner[start])
        runs.setdefault(of, []).append((start - int(ends[of]) + sizes[of], length, period))
    for at, (_, words) in enumerate(group):
        yield _facts(words, runs.get(at, []))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row.

    Of a tenth of the documents, chosen by their key, the tail is first replaced by repeats of its own beginning. Null and
    blank texts have no words: no runs, digests of nothing. Rows without a key keep their text as it is; repeated rows
    are each judged. An empty table gives no rows; other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for group in _groups(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for *counts, listed, collapsed in _of_group(group):
                    found.append((*counts, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
            columns = list(zip(*found)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            arrays = [batch.column(0), *map(pa.array, columns, kinds)]
            names = [key, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(key, text).mapInArrow(
        run,
        f"`{key}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string",
    )


def collapsed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, runs) of every row as it is: words joined by single spaces without the repeats of their runs.

    `runs` are (start, length, period), counted in words. Null texts stay null.
    """
    kind = docs.schema[key].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = [], []
            for one in batch.column(1).to_pylist():
                words = words_of(one)
                number: dict[bytes, int] = {}
                codes = np.fromiter((number.setdefault(word, len(number)) for word in words), np.int64, len(words))
                found = find_runs(codes, np.zeros(len(words), np.int64), np.full(len(words), len(words)))
                texts.append(None if one is None else _facts(words, found)[-1].decode())
                runs.append([dict(zip(("start", "length", "period"), run)) for run in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(runs, spans)], [key, "text", "runs"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, text string, runs array<struct<start: long, length: long, period: long>>")
