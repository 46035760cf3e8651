"""Benchmark passages in documents, found by an Aho-Corasick automaton.

Texts and items are normalised alike: A-Z lower-cased, words of digits, a-z and everything beyond ASCII,
joined by single spaces. The automaton holds every window of `window` item words (a shorter item is one
window) between spaces, and passes over each text once. Matches are mapped back to word numbers and to
code point offsets in the original text.

The items are a stated query set. They go to the tasks in blocks of at most `BLOCK_BYTES` of text, one
automaton each; a benchmark of usual size is one block, a larger one takes a pass per block.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stowline.llm.memos import hold

BLOCK_BYTES = 200_000
# bytes to normalised bytes: A-Z to a-z, other ASCII that is no letter or digit to a space
_NORMAL = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A else byte if byte >= 0x80 or 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A else 0x20
    for byte in range(256)
)
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


def _joined(words: list[bytes]) -> str:
    # one character a byte, so that offsets are byte offsets
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def build_automaton(items: list[tuple], window: int):
    """The automaton of the items' windows; a match gives (words, numbers of the items that hold it). None without windows."""
    import ahocorasick

    held: dict[str, tuple[int, set[int]]] = {}
    for number, (_, text) in enumerate(items):
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            held.setdefault(_joined(words[at : at + size]), (size, set()))[1].add(number)
    if not held:
        return None
    automaton = ahocorasick.Automaton()
    for pattern, found in held.items():
        automaton.add_word(pattern, found)
    automaton.make_automaton()
    return automaton


_built: dict[str, object] = {}


def _automaton(name: str, items: list[tuple], window: int):
    """One automaton at a time per Python worker."""
    hold(_built)
    if name not in _built:
        _built.clear()
        _built[name] = build_automaton(items, window)
    return _built[name]


def scan(automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, merged ranges of hit words, numbers of the items found) of one text."""
    words = words_of(text)
    if not words or automaton is None:
        return len(words), [], set()
    line = _joined(words)
    ranges: list[tuple[int, int]] = []
    found: set[int] = set()
    spaces = None
    for end, (size, numbers) in automaton.iter(line):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        last = int(np.searchsorted(spaces, end))  # the matched words end before this word
        ranges.append((last - size, last))
        found |= numbers
    return len(words), merged(ranges), found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(one) for one in out]


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """The ranges with code point offsets in the original text."""
    places = [match.span() for match in _WORD.finditer(text)]
    return [
        {"first_word": begin, "end_word": end, "begin": places[begin][0], "end": places[end - 1][1]} for begin, end in ranges
    ]


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    block: list[tuple] = []
    size = 0
    for row in benchmark.select(F.col(item).cast("string"), text).filter(F.col(text).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


_HITS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(key, n_words, hits, items) of every row: merged hit ranges and the distinct ids, as strings, of the items found.

    Null and empty texts have no words and no hits; null item texts have no windows; a null item id is left out of
    `items` but its windows count as hits. Repeated items and keys do no harm. An empty benchmark hits nothing.
    """
    kind = docs.schema[key].dataType.simpleString()
    shown = f"`{key}` {kind}, _text string, n_words long, hits array<struct<first_word: long, end_word: long, begin: long, end: long>>, items array<string>"
    state = docs.select(
        F.col(key),
        F.col(text).alias("_text"),
        F.lit(None).cast("long").alias("n_words"),
        F.array().cast("array<struct<first_word: long, end_word: long, begin: long, end: long>>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )

    def one_pass(state: DataFrame, items: list[tuple]) -> DataFrame:
        block = docs.sparkSession.sparkContext.broadcast(items)  # bounded by BLOCK_BYTES
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, block.value, window)
            for batch in batches:
                counts, hits, names = [], [], []
                for one, before, known in zip(*(batch.column(at).to_pylist() for at in (1, 3, 4))):
                    n_words, ranges, found = scan(automaton, one)
                    ranges = merged(ranges + [(hit["first_word"], hit["end_word"]) for hit in before])
                    counts.append(n_words)
                    hits.append(offsets(one, ranges) if ranges else [])
                    names.append(sorted({*known, *(block.value[at][0] for at in found if block.value[at][0] is not None)}))
                arrays = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, _HITS), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, [key, "_text", "n_words", "hits", "items"])

        return state.mapInArrow(run, shown)

    scanned = False
    for items in _blocks(benchmark, item, item_text):
        state, scanned = one_pass(state, items), True
    if not scanned:
        state = one_pass(state, [])
    return state.drop("_text")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, **names: str) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    found = find_passages(docs, benchmark, window, **names)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, one: total + one["end_word"] - one["first_word"])
    return found.select(
        names.get("key", "doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
