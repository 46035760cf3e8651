"""The main text of pages, with a suffix array over the token streams of a host.

Each page is cut into blocks, each in a zone: `article` (inside article or main), `chrome` (menus, headers, footers,
sidebars, notices, adverts, forms, comments), `open` (neither). The pages of a host lie one after another as a
token stream. Its suffixes, sorted by their first `RUN` tokens by prefix doubling, show which runs of tokens stand
in two pages or more. What they cover is repeated text; the rest are unique runs. Pages of one token stream count as
one page. A host is sorted in parts; the hashes of its runs, compared over the whole table, tell each part which of its
runs stand in other parts too.

Repetition alone cannot tell menus from articles here: articles share passages, adverts may be unique, and the
wanted text is the whole article. So the markup decides where it says something (article text stays, chrome goes),
and the suffix array decides where it does not: on pages without an article, repeated runs of open text are
removed and unique runs kept. For articles it gives the number of their repeated words.
"""

from __future__ import annotations

import html as entities
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stowline.llm.tables import new_folder, opened, stored

RUN = 8  # tokens, a power of two
PART_PAGES = 200
BATCH_CHARS = 16 << 20  # of html, whose runs a task holds at a time; a larger page is alone
BUCKET_BYTES = 32 << 20  # of html, whose runs one group compares
_PLACES = np.random.default_rng(20240608).integers(0, 1 << 63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

# Elements and class or id words that hold no main text (own choice).
SKIPPED = frozenset("head script style noscript template svg canvas iframe object nav header footer aside form button select textarea dialog menu".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer header masthead cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup comment comments reply "
    "replies disqus share sharing social related recommended widget toolbar pagination pager login search".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Markup of a well-formed page in one search; a lone "<" is a tag that does not end, after which `_Tokens` goes on.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>?|</?([A-Za-z][^\s/>\"']*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?=/?[A-Za-z])", re.S
)
_MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[A-Za-z])")
_NAME = re.compile(r"</?([A-Za-z][^\s/>\"']*)")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}
_WORDS = re.compile(r"[^\W_]+")
_NEGATED = frozenset(("no", "not", "has", "have", "with", "without", "hide", "is"))


def _is_chrome(attributes: str, whole: bool = False) -> bool:
    """Whether attributes mark menus, adverts and the like; with `whole`, all words of a class or id have to say so."""
    if not attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in CHROME_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id"):
            for one in value.split():
                words = _WORDS.findall(one)
                if whole:
                    if words and CHROME.issuperset(words):
                        return True
                elif words and (words[0] in CHROME or words[-1] in CHROME) and not _NEGATED.intersection(words):
                    return True
    return False


class _Tokens:
    """Markup of a page from left to right. Time is linear in the page's length, however many tags never end.

    A ">" between quotes does not end a tag. A tag that does not end, or has a quote without its other one, is text.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.special = -1  # the first quote or ">" after the latest tag's begin
        self.dead: set[int] = set()  # opening quotes after which a tag does not end

    def _next_special(self, at: int) -> int:
        found = _SPECIAL.search(self.page, at)
        return found.start() if found else len(self.page)

    def _tag_end(self, at: int) -> int:
        """The place behind the ">" of the tag whose inside begins here, or -1."""
        if at > self.last:
            return -1
        if self.special < at:
            self.special = self._next_special(at)
        place, passed = self.special, []
        while place <= self.last and place not in self.dead:
            if self.page[place] == ">":
                return place + 1
            passed.append(place)
            other = self.page.find(self.page[place], place + 1)
            if other < 0:
                break
            place = self._next_special(other + 1)
        self.dead.update(passed)
        return -1

    def after(self, at: int) -> tuple[int, int, str, str] | None:
        """(begin, end, name, attributes) of the next markup; the name is empty for comments and declarations."""
        page = self.page
        while found := _MARKUP.search(page, at):
            begin, at = found.span()
            kind = found[0]
            if kind == "<!--":
                end = page.find("-->", at)
                return begin, end + 3 if end >= 0 else len(page), "", ""
            if kind == "<![CDATA[":
                return begin, at, "", ""
            if kind in ("<!", "<?"):
                return begin, page.find(">", at) + 1 or len(page), "", ""
            end = self._tag_end(at)
            if end >= 0:
                name = _NAME.match(page, begin, end)
                return begin, end, name[1], page[name.end() : end - 1]
        return None


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(zone, text) of every block that has text, in page order; references decoded, white space made one space."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements with the zone inside them
    within: Counter = Counter()
    zone = "open"
    held: list[str] = []

    def close_block() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((zone, text))

    def pop() -> None:
        nonlocal zone
        name, _ = stack.pop()
        within[name] -= 1
        new = stack[-1][1] if stack else "open"
        if new != zone:
            close_block()
        zone = new

    at = 0
    tokens = None
    while True:
        if tokens is None:
            if not (match := _TOKEN.search(page, at)):
                break
            begin, end = match.span()
            if end - begin == 1:
                tokens = _Tokens(page)
                continue
            name, attributes = match.groups("")
        else:
            if not (found := tokens.after(at)):
                break
            begin, end, name, attributes = found
        if zone != "skip" and begin > at:
            held.append(page[at:begin])
        at = end
        name = name.lower()
        if not name:
            continue
        closing = page.startswith("</", begin)
        if name not in INLINE and name not in _RAW_END:
            if zone != "skip":
                close_block()
        if closing:
            if within[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
            at = page.find(">", at) + 1 or len(page)
            continue
        if name in VOID or attributes.endswith("/") and name in INLINE:
            continue
        inner = zone
        if zone in ("open", "article"):
            if name in SKIPPED or name not in ("html", "body", "article", "main") and _is_chrome(attributes, zone == "article"):
                inner = "skip" if name == "head" else "chrome"
            elif name in ("article", "main") or 'role="main"' in attributes:
                inner = "chrome" if name == "article" and zone == "article" and _is_chrome(attributes, True) else "article"
        if inner != zone:
            close_block()
        stack.append((name, inner))
        within[name] += 1
        zone = inner
    # an open "<" begins a tag that never ends: what is before it is text
    if zone != "skip":
        rest = page[at:]
        cut = re.search(r"<[/!?A-Za-z]", rest)
        held.append(rest[: cut.start()] if cut else rest)
        close_block()
    return out


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


_word_hashes = _WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_word_hashes) > 500_000:
        _word_hashes.clear()
    return np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of RUN tokens, the same in every process."""
    size = max(0, len(hashes) - RUN + 1)
    total = np.zeros(size, np.uint64)
    for place in range(RUN):
        total += hashes[place : place + size] * _PLACES[place]
    return mixed(total)


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(32))


def _stream_digest(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def repeated_tokens(stream: np.ndarray, page: np.ndarray, content: np.ndarray | None = None, elsewhere: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in a run of RUN tokens that two pages share. Runs do not cross pages.

    Pages of equal `content` are one page. Runs that begin at an `elsewhere` token are shared in any case.

    Prefix doubling: after k rounds equal ranks mean that the suffixes agree in 2^k tokens.
    """
    size = len(stream)
    covered = np.zeros(size, bool)
    content = page if content is None else content
    if size < (2 * RUN if elsewhere is None else RUN):
        return covered
    _, rank = np.unique(stream, return_inverse=True)
    span = 1
    while span < RUN:
        ahead = np.full(size, -1, np.int64)
        ahead[: size - span] = np.where(page[: size - span] == page[span:], rank[span:], -1)
        _, rank = np.unique(rank * (int(rank.max()) + 2) + ahead + 1, return_inverse=True)
        span *= 2
    whole = np.zeros(size, bool)
    whole[: size - RUN + 1] = page[: size - RUN + 1] == page[RUN - 1 :]
    suffixes = np.flatnonzero(whole)
    suffixes = suffixes[np.lexsort((content[suffixes], rank[suffixes]))]  # the suffix array, by the first RUN tokens
    same = rank[suffixes[1:]] == rank[suffixes[:-1]]
    other_page = content[suffixes[1:]] != content[suffixes[:-1]]
    # pages are in order within equal suffixes, so a group with two pages has a step between some neighbours
    group = np.concatenate(([0], np.cumsum(~same)))
    shared = np.zeros(int(group[-1]) + 1 if len(group) else 1, bool)
    shared[group[1:][same & other_page]] = True
    begins = suffixes[shared[group]] if len(suffixes) else suffixes
    if elsewhere is not None:
        begins = np.union1d(begins, np.flatnonzero(whole & elsewhere))
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, begins, 1)
    np.add.at(marks, begins + RUN, -1)
    return np.cumsum(marks[:-1]) > 0


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Where the values of an ascending array change, its begin included."""
    if not len(ascending):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(ascending[1:] != ascending[:-1]) + 1))


class BatchRuns:
    """The token streams of the pages of a batch and the hashes of their runs. A hash has the host mixed in, so runs of two hosts differ."""

    def __init__(self, htmls: Iterable[str | None], hosts: Iterable[str]):
        self.blocks = [blocks_of(html or "") for html in htmls]
        texts = [" ".join([text for _, text in blocks]) for blocks in self.blocks]
        split = pc.split_pattern(pa.array([text for text in texts if text], pa.large_string()), " ")
        numbered = split.flatten().dictionary_encode()
        self.numbers = numbered.indices.to_numpy()  # of the words, one page after another
        words = word_hashes(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())[self.numbers]
        self.lengths = np.zeros(len(texts), np.int64)
        self.lengths[[at for at, text in enumerate(texts) if text]] = np.diff(split.offsets.to_numpy())
        ends = np.cumsum(self.lengths)
        self.begins = ends - self.lengths
        digests = [_stream_digest(words[low:high]) for low, high in zip(self.begins.tolist(), ends.tolist())]
        self.digests, self.content = np.unique(np.array(digests, np.uint64), return_inverse=True)
        # runs do not cross pages
        sizes = np.maximum(self.lengths - RUN + 1, 0)
        self.at = np.arange(sizes.sum()) + np.repeat(self.begins - (np.cumsum(sizes) - sizes), sizes)
        salts = np.array([xxhash.xxh3_64_intdigest(host.encode()) for host in hosts], np.uint64)
        self.runs = mixed(run_hashes(words)[self.at] + np.repeat(salts, sizes))
        self.stream = np.repeat(self.content.astype(np.int32), sizes)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, least, greatest number of a stream that holds it), by hash, and for every run the place of its hash there."""
        order = np.argsort(self.runs)
        hashes, streams = self.runs[order], self.stream[order]
        first = _steps(hashes)
        if not len(first):
            return hashes, streams, streams, order
        which = np.empty(len(hashes), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hashes))))
        return hashes[first], np.minimum.reduceat(streams, first), np.maximum.reduceat(streams, first), which


def packed_slots(slots: np.ndarray, width: int) -> bytes:
    """Ascending distinct numbers below `width` in about 2 + log2(width / count) bits each: low bits plainly, steps of the rest in unary."""
    low = max(0, int(width // max(1, len(slots))).bit_length() - 1)
    high = (slots >> np.uint64(low)).astype(np.int64)
    steps = np.zeros(len(slots) + int(high[-1] if len(high) else 0) + 1, np.uint8)
    steps[high + np.arange(len(slots))] = 1
    rest = np.unpackbits(slots.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=low, bitorder="little")
    return struct.pack("<IB", len(slots), low) + np.packbits(rest).tobytes() + np.packbits(steps).tobytes()


def opened_slots(block: bytes) -> np.ndarray:
    count, low = struct.unpack_from("<IB", block)
    bits = np.frombuffer(block, np.uint8, offset=5)
    cut = -(-count * low // 8)
    rest = np.zeros((count, 64), np.uint8)
    rest[:, :low] = np.unpackbits(bits[:cut], count=count * low).reshape(count, low)
    high = np.flatnonzero(np.unpackbits(bits[cut:])) - np.arange(count)
    return (high.astype(np.uint64) << np.uint64(low)) | np.packbits(rest, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


class Exchange:
    """How the batches of a table learn which of their runs other batches hold, while the pages stay where they are read.

    A hash's first `bits` bits are its slot. Batches send the slots they hold, packed, in `buckets` stretches, and get back
    a bit for each: whether another batch holds it too. Of the runs in such slots they send the whole hashes with their
    streams, and get back a bit for each: whether two streams hold it. A batch goes by its task's partition and its number there.
    """

    def __init__(self, size: int):
        """For a table of so many bytes of html."""
        self.buckets = -(-size // BUCKET_BYTES) or 1
        self.bits = max(16, int(size * 10).bit_length())  # about 64 slots for every run
        self.edges = np.array([-(-(at << self.bits) // self.buckets) for at in range(self.buckets + 1)], np.uint64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def _stretches(self, slots: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, low, high) of ascending slots."""
        cuts = np.searchsorted(slots, self.edges).tolist()
        yield from ((at, low, high) for at, (low, high) in enumerate(pairwise(cuts)) if high > low)

    def announced(self, batch: BatchRuns) -> Iterator[tuple]:
        slots = np.sort(self.slots(batch.runs))
        slots = slots[_steps(slots)]
        for bucket, low, high in self._stretches(slots):
            edge = self.edges[bucket]
            yield bucket, packed_slots(slots[low:high] - edge, int(self.edges[bucket + 1] - edge))

    def candidates(self, distinct: tuple, masks: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, place among the distinct hashes, stream's number) of the runs in slots that other batches hold, with a run's
        first and last stream; and in the order in which `asked` sends them."""
        hashes, least, greatest, _ = distinct
        slots = self.slots(hashes)
        first = _steps(slots)
        known = slots[first]
        flagged = np.zeros(len(known), bool)
        for bucket, low, high in self._stretches(known):
            flagged[low:high] = _bits(masks[bucket], high - low)
        held = np.flatnonzero(np.repeat(flagged, np.diff(np.append(first, len(slots)))))
        several = held[least[held] != greatest[held]]
        places = np.concatenate((held, several))
        streams = np.concatenate((least[held], greatest[several]))
        bucket = np.searchsorted(self.edges, slots[places], "right") - 1
        order = np.lexsort((places, streams, bucket))  # a stream's runs together, so digests compress
        return bucket[order], places[order], streams[order]

    def asked(self, batch: BatchRuns, masks: dict[int, bytes]) -> Iterator[tuple]:
        distinct = batch.distinct()
        bucket, places, streams = self.candidates(distinct, masks)
        hashes = distinct[0][places]
        digests = (batch.digests & np.uint64(0xFFFFFFFF)).astype(np.uint32)[streams]
        for one, low, high in _equal_stretches(bucket):
            yield one, hashes[low:high].tobytes() + digests[low:high].tobytes()

    def marks(self, batch: BatchRuns, masks: dict[int, bytes], answers: dict[int, bytes]) -> np.ndarray:
        """Which tokens of the batch begin a run that two streams of their host hold."""
        distinct = batch.distinct()
        bucket, places, _ = self.candidates(distinct, masks)
        _, least, greatest, which = distinct
        shared = least != greatest
        for one, low, high in _equal_stretches(bucket):
            shared[places[low:high][_bits(answers[one], high - low)]] = True
        marks = np.zeros(len(batch.numbers), bool)
        marks[batch.at[shared[which]]] = True
        return marks


def _equal_stretches(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    which, begins = np.unique(values, return_index=True)
    yield from zip(which.tolist(), begins.tolist(), [*begins[1:].tolist(), len(values)])


def _bits(block: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(block, np.uint8), count=count).astype(bool)


def slots_of_several(rows: pd.DataFrame) -> list[bytes]:
    """For the packed slots of every row, bits that tell which slots another row holds."""
    slots = [opened_slots(block) for block in rows["_sent"]]
    every = np.concatenate(slots)
    order = np.argsort(every, kind="stable")  # ascending stretches, merged
    every = every[order]
    marks = np.zeros(len(every), bool)
    same = every[1:] == every[:-1]
    marks[order[1:][same]] = True
    marks[order[:-1][same]] = True
    return [np.packbits(one).tobytes() for one in np.split(marks, np.cumsum(list(map(len, slots)))[:-1])]


def runs_of_several(rows: pd.DataFrame) -> list[bytes]:
    """For the hashes of every row, bits that tell which runs are held by two token streams."""
    counts = [len(block) // 12 for block in rows["_sent"]]
    hashes = np.concatenate([np.frombuffer(block, np.uint64, count) for block, count in zip(rows["_sent"], counts)])
    streams = np.concatenate([np.frombuffer(block, np.uint32, offset=8 * count) for block, count in zip(rows["_sent"], counts)])
    order = np.argsort(hashes)
    first = _steps(hashes[order])
    several = np.minimum.reduceat(streams[order], first) != np.maximum.reduceat(streams[order], first)
    marks = np.empty(len(hashes), bool)
    marks[order] = np.repeat(several, np.diff(np.concatenate((first, [len(hashes)]))))
    return [np.packbits(one).tobytes() for one in np.split(marks, np.cumsum(counts)[:-1])]


def _batches(found: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pages in stretches of about BATCH_CHARS, so a task's memory does not grow with Spark's batches."""
    for pages in found:
        sizes = np.array([len(html or "") for html in pages["_html"]], np.int64)
        cuts = _steps((np.cumsum(sizes) - sizes) // BATCH_CHARS)
        for low, high in pairwise([*cuts.tolist(), len(pages)]):
            yield pages.iloc[low:high]


def _answered(sent: DataFrame, answer: Callable[[pd.DataFrame], list[bytes]], name: str) -> str:
    """The folder of the answers to what batches sent, by the partition of the pages that they are for."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["_source", "_batch", "_bucket", "_digest"]].assign(_bits=answer(rows))

    answers = sent.groupBy("_bucket").applyInPandas(run, "_source int, _batch int, _bucket int, _digest long, _bits binary")
    folder = new_folder(sent.sparkSession, name)
    answers.repartition("_source").write.partitionBy("_source").parquet(folder)
    return folder


def _answers_for(folder: str, source: int) -> dict[int, list[dict]]:
    """The rows of every batch of a partition of the pages."""
    fs, inside = opened(f"{folder}/_source={source}")
    found: dict[int, list[dict]] = {}
    for file in fs.get_file_info(pafs.FileSelector(inside, allow_not_found=True)):
        if file.base_name.endswith(".parquet"):
            for row in pq.read_table(file.path, filesystem=fs, partitioning=None).to_pylist():
                found.setdefault(row["_batch"], []).append(row)
    return found


def extract_host(pages: pd.DataFrame, key: str, url: str) -> pd.DataFrame:
    """(key, url, text, n_repeated_words) of the pages of one host."""
    return _extracted(pages, key, url, BatchRuns(pages["_html"], [""] * len(pages)), np.arange(len(pages)))


def _extracted(pages: pd.DataFrame, key: str, url: str, runs: BatchRuns, places: np.ndarray, elsewhere: np.ndarray | None = None) -> pd.DataFrame:
    """The same of some pages of a batch, all of one host; `elsewhere` marks the tokens of the batch that begin a shared run."""
    lengths = runs.lengths[places]
    ends = np.cumsum(lengths)
    tokens = np.arange(lengths.sum()) + np.repeat(runs.begins[places] - (ends - lengths), lengths)
    owner = np.repeat(np.arange(len(places)), lengths)
    covered = repeated_tokens(runs.numbers[tokens], owner, np.repeat(runs.content[places], lengths), None if elsewhere is None else elsewhere[tokens])
    before = np.concatenate(([0], np.cumsum(covered)))
    at = 0
    texts, repeats = [], []
    for place in places.tolist():
        blocks = runs.blocks[place]
        has_article = any(zone == "article" for zone, _ in blocks)
        kept, repeated = [], 0
        for zone, text in blocks:
            end = at + text.count(" ") + 1
            if zone == "article":
                kept.append(text)
                repeated += int(before[end] - before[at])
            elif zone == "open" and not has_article:
                unique = [word for word, gone in zip(text.split(" "), covered[at:end]) if not gone]
                if unique:
                    kept.append(" ".join(unique))
            at = end
        texts.append(" ".join(kept))
        repeats.append(repeated)
    some = pages.iloc[places]
    return pd.DataFrame({key: some[key], url: some[url], "text": texts, "n_repeated_words": repeats})


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_repeated_words) of every page; text is empty if there is none.

    Pages are read three times and never shuffled: batches of pages tell each other which runs they share (see `Exchange`), so the
    result does not depend on the batches. Pages that are themselves a shuffle's or a sort's result are stored first, since every read
    has to give the same batches; a read that does not is refused.
    Null html is empty; null urls form one host; null and repeated keys pass through, a row each. An empty table
    gives no rows; other columns are left out.
    """
    types = pages.schema
    host = F.lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(key), F.col(url), F.col(html).alias("_html"), host.alias("_host"))
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = stored(rows, "pages")
    exchange = Exchange(rows.agg(F.sum(F.octet_length("_html"))).first()[0] or 0)

    def batches_of(found: Iterator[pd.DataFrame], *folders: str) -> Iterator[tuple]:
        """(pages, runs, their digest, source, batch, the bits of each folder by bucket)."""
        source = TaskContext.get().partitionId()
        answers = [_answers_for(folder, source) for folder in folders]
        for batch, part in enumerate(_batches(found)):
            runs = BatchRuns(part["_html"], part["_host"])
            digest = int(np.bitwise_xor.reduce(runs.runs, initial=0) >> np.uint64(1)) ^ len(runs.runs)
            of_batch = [one.pop(batch, []) for one in answers]
            if any(row["_digest"] != digest for of in of_batch for row in of) or len(runs.runs) and not all(of_batch[:1]):
                raise ValueError("the pages were not read alike twice; store them first")
            yield part, runs, digest, source, batch, [{row["_bucket"]: row["_bits"] for row in of} for of in of_batch]

    def sending(rows_of: Callable, *folders: str) -> DataFrame:
        def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, runs, digest, source, batch, bits in batches_of(found, *folders):
                sent = [(source, batch, bucket, digest, block) for bucket, block in rows_of(runs, *bits)]
                yield pd.DataFrame(sent, columns=["_source", "_batch", "_bucket", "_digest", "_sent"])

        return rows.mapInPandas(run, "_source int, _batch int, _bucket int, _digest long, _sent binary")

    held = _answered(sending(exchange.announced), slots_of_several, "shared-slots")
    repeated = _answered(sending(exchange.asked, held), runs_of_several, "shared-runs")

    def extract(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, runs, _, _, _, bits in batches_of(found, held, repeated):
            marks = exchange.marks(runs, *bits)
            for places in part.groupby("_host", sort=False).indices.values():
                for low in range(0, len(places), PART_PAGES):
                    yield _extracted(part, key, url, runs, places[low : low + PART_PAGES], marks)

    schema = f"`{key}` {types[key].dataType.simpleString()}, `{url}` string, text string, n_repeated_words long"
    found = rows.mapInPandas(extract, schema)
    return found.select(key, url, "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated_words")
