"""Byte-level BPE pieces of a text, remembered per Python worker.

A space after a character that is not white space always begins a new pre-token, so a text falls
into chunks there, each tokenized without its neighbours. So does a line break between two such characters. Most chunks repeat; a bounded memo keeps
what the tokenizer gave for them. The bound limits memory only: a dropped chunk is worked out again.
"""

from __future__ import annotations

import re
import string
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress, count, pairwise, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as the byte-level pre-tokenizer sees it (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_WIDE_SPACE = re.compile(f"[{WHITE}]{{2}}|^\n|[{WHITE}]\\Z")
_BREAK = re.compile(f"(?<=[^{WHITE}]) ")
# WHITE holds a range
_RARE_SPACE = [mark for mark in re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))) if mark not in " \n"]
_MARKS = string.punctuation  # none is a letter, a number or white space, so a run of them at the end of a word is a pre-token
MEMO_ENTRIES = 500_000
_JOINED_CHARS = 200_000
_GROUP_CHARS = 2_000_000
_MARK_ENTRIES = 10_000
_PACK = [struct.Struct(f"<{size}I").pack for size in range(64)]


def _plain_space(text: str) -> bool:
    """Whether white space stands between other characters only, one at a time. Plain searches decide for most texts."""
    for mark in _RARE_SPACE:
        if mark in text:
            return not _WIDE_SPACE.search(text)
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text.startswith("\n") or text.endswith((" ", "\n")))


def split_chunks(text: str) -> list[str]:
    """The chunks; `spelled` tells what each but the first stands for."""
    if _plain_space(text):
        return text.replace("\n", " \n").split(" ")
    first, *rest = _BREAK.split(text)
    return [first, *(" " + chunk for chunk in rest)]


def spelled(chunk: str) -> str:
    """The text of a chunk after the first: the space before it is left out unless the chunk begins with white space itself."""
    return chunk if chunk[0] in "\n " else " " + chunk


def by_size(texts: Iterable[str | None], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive texts in groups of about so many characters; null becomes empty."""
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


class ChunkMemo:
    """Values of chunks. `compute` gives the values of a list of distinct chunks (with their spaces).

    Two generations of at most `entries` each: what is still in use moves to the young one, the rest goes.
    """

    def __init__(self, compute: Callable[[list[str]], list], entries: int = MEMO_ENTRIES):
        self.compute, self.entries, self.young, self.old = compute, entries, {}, {}

    def clear(self) -> None:
        """Forgets everything; mappings that `learn` gave stay as they are."""
        self.young, self.old = {}, {}

    def learn(self, chunks: set[str]) -> dict:
        """A mapping that holds all these chunks."""
        absent = chunks.difference(self.young)
        if len(self.young) + len(absent) > self.entries:
            self.old, self.young, absent = self.young, {}, chunks
        known = {chunk: self.old[chunk] for chunk in absent if chunk in self.old}
        self.young.update(known)
        missing = [chunk for chunk in absent if chunk not in known]
        self.young.update(zip(missing, self.compute([spelled(chunk) for chunk in missing])))
        return self.young

    def values(self, chunks: list[str]) -> list:
        """The value of each of these chunks, which may repeat."""
        found = list(map(self.young.get, chunks))
        places = list(compress(count(), map(is_, found, repeat(None))))
        if places:
            absent = [chunks[at] for at in places]
            known = self.learn(set(absent))
            for at, chunk in zip(places, absent):
                found[at] = known[chunk]
        return found


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(printable)]
    shown = {byte: chr(byte) for byte in printable} | {byte: chr(256 + at) for at, byte in enumerate(others)}
    return [shown[byte] for byte in range(256)]


class IdEncoder:
    """Token ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.shown = byte_alphabet()
        self.line_break = self._whole("\n")
        self.marks: dict[str, bytes] = {"": b""}
        self.memo = ChunkMemo(self._values)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pre_token(self, text: str) -> bytes:
        """The ids of one pre-token, by the library's model."""
        # the space is the only ASCII character here that the byte alphabet writes differently
        shown = text.replace(" ", self.shown[0x20]) if text.isascii() else "".join(map(self.shown.__getitem__, text.encode()))
        ids = [token.id for token in self.model.tokenize(shown)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def _mark_ids(self, marks: str) -> bytes:
        ids = self._pre_token(marks)
        if len(self.marks) < _MARK_ENTRIES and len(marks) <= 16:
            self.marks[marks] = ids
        return ids

    def _values(self, chunks: list[str]) -> list[bytes]:
        """Most chunks are letters, or letters and marks behind them: one or two pre-tokens for certain. The rest goes to the tokenizer."""
        out: list = [None] * len(chunks)
        rest, marks, young, old = [], self.marks, self.memo.young, self.memo.old
        fresh: dict[str, bytes] = {}  # letters that stand here with several marks
        for at, chunk in enumerate(chunks):
            bare = chunk.rstrip(_MARKS)
            body = bare[1:]
            if body.isalpha():
                tail = chunk[len(bare) :]
                if chunk[0] == "\n":
                    ids = self.line_break + self._pre_token(body)
                elif (ids := young.get(body) or old.get(body) or fresh.get(body)) is None:
                    ids = fresh[body] = self._pre_token(bare)
                out[at] = ids + (marks.get(tail) or self._mark_ids(tail)) if tail else ids
            elif chunk[-1] in WHITE:
                out[at] = self._whole(chunk)  # its white space would join that of the next chunk
            else:
                rest.append(at)
        for at, ids in zip(rest, self._chunks([chunks[at] for at in rest])):
            out[at] = ids
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Many chunks in one call; the tokens' character offsets tell them apart."""
        out: list[bytes] = []
        at = 0
        while at < len(chunks):
            size, end = 0, at
            while end < len(chunks) and (size == 0 or size + len(chunks[end]) <= _JOINED_CHARS):
                size += len(chunks[end])
                end += 1
            group = chunks[at:end]
            encoded = self.tokenizer.encode("".join(group), add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4")
            begins = np.fromiter(chain.from_iterable(encoded.offsets), np.int64, 2 * len(ids))[::2]
            edges = np.cumsum([0] + [len(chunk) for chunk in group])
            cuts = np.searchsorted(begins, edges)
            raw = ids.tobytes()
            out += [raw[4 * low : 4 * high] for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            at = end
        return out

    def _behind_heads(self, tails: list[str]) -> list[bytes]:
        """The ids of texts whose chunks a space parts. Arrow numbers the distinct chunks, so each is looked up once."""
        split = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        numbered = split.flatten().dictionary_encode()
        values = self.memo.values(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        pool = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begins = np.cumsum(sizes) - sizes
        which = numbered.indices.to_numpy()
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        places = np.repeat(begins[which] - (ends - lengths), lengths)
        places += np.arange(len(places))
        raw = pool[places].tobytes()
        edges = 4 * np.concatenate(([0], ends))[split.offsets.to_numpy()]
        return [raw[low:high] for low, high in pairwise(edges.tolist())]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; null counts as empty."""
        for group in by_size(texts, _GROUP_CHARS):
            heads: list[tuple[bytes, bool]] = []  # (ids, whether chunks among the tails follow)
            tails: list[str] = []
            for text in group:
                if any(word in text for word in self.special):
                    heads.append((self._whole(text), False))
                elif _plain_space(text):
                    head, space, tail = text.replace("\n", " \n").partition(" ")
                    heads.append((self._whole(head) if head else b"", bool(space)))
                    if space:
                        tails.append(tail)
                else:
                    head, *chunks = split_chunks(text)
                    heads.append(((self._whole(head) if head else b"") + b"".join(self.memo.values(chunks)), False))
            behind = iter(self._behind_heads(tails))
            for head, more in heads:
                yield head + next(behind) if more else head


_encoders: dict[str, IdEncoder] = {}


def id_encoder(tokenizer_file: str) -> IdEncoder:
    """One encoder per Python worker and file."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = IdEncoder(tokenizer_file)
    return _encoders[tokenizer_file]
