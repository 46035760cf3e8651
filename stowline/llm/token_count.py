"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

A pre-token is a list of symbols (one per byte). The heap holds (rank, position) of adjacent pairs; the
lowest rank, leftmost first, is merged, its two new neighbours are pushed, and stale entries are skipped.
The count is the number of symbols less the merges, in O(n log n) for a pre-token of n bytes.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stowline.llm.chunks import WHITE, ChunkMemo, by_size, byte_alphabet, split_chunks


class HeapMerger:
    """Counts the symbols that remain of one pre-token."""

    def __init__(self, merges: list):
        pairs = [tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge) for merge in merges]
        self.rank = {pair: at for at, pair in enumerate(pairs)}
        self.alphabet = byte_alphabet()

    def count(self, pre_token: str) -> int:
        symbols: list = [self.alphabet[byte] for byte in pre_token.encode()]
        size = len(symbols)
        rank = self.rank
        heap = [(order, at) for at in range(size - 1) if (order := rank.get((symbols[at], symbols[at + 1]))) is not None]
        heapq.heapify(heap)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        merges = 0
        while heap:
            order, left = heapq.heappop(heap)
            if symbols[left] is None or (right := after[left]) >= size or rank.get((symbols[left], symbols[right])) != order:
                continue
            symbols[left] += symbols[right]
            symbols[right] = None
            merges += 1
            after[left] = follower = after[right]
            if follower < size:
                before[follower] = left
                if (order := rank.get((symbols[left], symbols[follower]))) is not None:
                    heapq.heappush(heap, (order, left))
            if (leader := before[left]) >= 0 and (order := rank.get((symbols[leader], symbols[left]))) is not None:
                heapq.heappush(heap, (order, leader))
        return size - merges


def _ranges(codes: list[int]) -> str:
    out: list[list[int]] = []
    for code in codes:
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in out)


def pre_token_pattern(pre_tokenizer) -> re.Pattern:
    """The pre-token pattern of byte-level BPE.

    Letters and numbers come from the interpreter's Unicode tables; code points newer than these are
    classed as the tokenizer file's own pre-tokenizer classes them.
    """
    codes: dict[str, list[int]] = {"L": [], "N": []}
    newer: list[int] = []
    for code in range(0x40000):
        kind = unicodedata.category(chr(code))
        if kind == "Cn":
            newer.append(code)
        elif kind[0] in codes:
            codes[kind[0]].append(code)
    for at in range(0, len(newer), 20_000):
        part = newer[at : at + 20_000]
        # "a" and a letter stay together, so do "1" and a number; a line break parts the probes
        for kind, mark in (("L", "a"), ("N", "1")):
            found = pre_tokenizer.pre_tokenize_str("\n".join(mark + chr(code) for code in part))
            joined = {low // 3 for _, (low, high) in found if high - low == 2 and low % 3 == 0}
            codes[kind] += [code for place, code in enumerate(part) if place in joined]
    letter, number = (_ranges(sorted(codes[kind])) for kind in "LN")
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+"
        f"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    )


class TokenCounter:
    """Counts whole texts; special strings count one token each, as the library takes them by default."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as file:
            described = json.load(file)
        self.merger = HeapMerger(described["model"]["merges"])
        self.pattern = pre_token_pattern(Tokenizer.from_file(tokenizer_file).pre_tokenizer)
        special = sorted((token["content"] for token in described["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pre_tokens: dict[str, int] = {}
        self.memo = ChunkMemo(lambda chunks: [self._plain(chunk) for chunk in chunks])

    def _plain(self, text: str) -> int:
        total = 0
        known = self.pre_tokens
        for pre_token in self.pattern.findall(text):
            count = known.get(pre_token)
            if count is None:
                count = self.merger.count(pre_token)
                if len(pre_token) <= 64:
                    if len(known) >= 300_000:
                        known.clear()
                    known[pre_token] = count
            total += count
        return total

    def count_all(self, texts) -> Iterator[int]:
        for group in by_size(texts):
            marks = [len(self.special.findall(text)) if self.special else 0 for text in group]
            pieces = [self.special.split(text) if mark else [text] for text, mark in zip(group, marks)]
            split = [[split_chunks(piece) for piece in texts_of if piece] for texts_of in pieces]
            known = self.memo.learn({chunk for texts_of in split for chunks in texts_of for chunk in chunks[1:]})
            for mark, texts_of in zip(marks, split):
                yield mark + sum(
                    self._plain(chunks[0]) + sum([known[chunk] for chunk in chunks[1:]]) for chunks in texts_of
                )


_counters: dict[str, TokenCounter] = {}


def counter(tokenizer_file: str) -> TokenCounter:
    """One counter per Python worker and file."""
    if tokenizer_file not in _counters:
        _counters[tokenizer_file] = TokenCounter(tokenizer_file)
    return _counters[tokenizer_file]


def count_tokens(
    docs: DataFrame, tokenizer_file: str, limit: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of `docs`.

    Null texts count as empty (0 bytes, 0 tokens). Nulls and repeats of the key pass through, one row
    each; other columns are left out. An empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key), F.octet_length(F.coalesce(text, F.lit(""))).cast("long"), F.col(text)).toDF(
        key, "n_bytes", "_text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_file)
        for batch in batches:
            counts = pa.array(count.count_all(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], [key, "n_bytes", "n_tokens"])

    counted = narrow.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
