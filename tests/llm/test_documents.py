"""Decontamination, quality rules and shards against brute force, and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from stowline.llm import decontamination
from stowline.llm.decontamination import contamination, find_passages
from stowline.llm.kd_shards import shard_documents, write_shards
from stowline.llm.quality import frequent_lines, judge_documents, measure_documents, without_frequent_lines
from stowline.llm.queries import QUERIES
from tests.llm.common import SMALL, documents, odd_documents, odd_rows, rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def normal(text):
    return WORD.findall("".join(chr(ord(one) + 32) if "A" <= one <= "Z" else one for one in text or ""))


def brute_hits(given, items, window=10):
    windows = defaultdict(set)
    for item, passage in items:
        of = normal(passage)
        size = min(window, len(of))
        for at in range(len(of) - size + 1 if size else 0):
            windows[tuple(of[at : at + size])].add(str(item))
    out = []
    for key, text in given:
        words, hit, found = normal(text), set(), set()
        for size in set(map(len, windows)):
            for begin in range(len(words) - size + 1):
                if items_of := windows.get(tuple(words[begin : begin + size])):
                    hit |= set(range(begin, begin + size))
                    found |= items_of
        names = ",".join(sorted(found))
        out.append((key, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [200_000, 1])
def test_passages(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    rng = random.Random(2)
    items = [(at, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 16)))) for at in range(8)]
    items += [(9, None), (10, ""), (11, "É clair, n'est"), (11, "É clair, n'est"), (120, "one two three four five")]
    texts = [", ".join(rng.choice(["a", "B", "b", "A", "c"]) for _ in range(40)) for _ in range(30)] + ["x É-clair N est y", "é clair n est"]
    given = [*odd_rows(), *enumerate(texts, 100)]
    docs = odd_documents(spark).union(documents(spark, texts, 100))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = sorted(map(tuple, contamination(docs, benchmark).collect()), key=repr)
    assert found == brute_hits(given, items)
    spans = find_passages(documents(spark, ["No: x É-clair, N est! y"]), benchmark).first().hits
    assert any("No: x É-clair, N est! y"[span.begin : span.end] == "É-clair, N est" for span in spans)
    nothing = contamination(docs, benchmark.limit(0)).collect()
    assert len(nothing) == len(given) and not any(row.contaminated for row in nothing)
    assert contamination(docs.limit(0), benchmark).count() == 0


def test_passage_query(spark):
    result = sorted(map(tuple, QUERIES["op6_decontamination"](spark, SMALL).collect()), key=repr)
    assert result == brute_hits([(doc[0], doc[1]) for doc in rows("documents")], rows("benchmark"))


def brute_base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {at + step for at in range(len(words) - 2) if windows[tuple(words[at : at + 3])] > 1 for step in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_counts(spark):
    result = sorted(((row[0], *row[1:6]) for row in judge_documents(odd_documents(spark)).collect()), key=repr)
    assert result == sorted(((key, *brute_base(text)) for key, text in odd_rows()), key=repr)
    assert judge_documents(odd_documents(spark).limit(0)).count() == 0


def test_line_frequency(spark):
    rng = random.Random(4)
    own = lambda words: " ".join(f"v{rng.randrange(10**6)}" for _ in range(words))
    menu = "Home   12  About " + "Menu " * 60
    clean = [own(80) + "\n" + menu.replace("12", f"{at:02d}") for at in range(30)]
    only_menu = [menu + "\n" + own(5) + f" {at}" for at in range(5)]
    copies = ["\n".join([own(30), own(30)])] * 40
    docs = documents(spark, clean + only_menu + copies, sources=["h"] * 75)
    kept = {row.doc_id for row in judge_documents(docs, line_texts=20).filter("kept").collect()}
    # menus are frequent; pages that are little else go, copies of one text do not make its lines frequent
    assert kept == set(range(30)) | set(range(35, 75))
    frequent = frequent_lines(measure_documents(docs, "doc_id", "text", "source"), 20, 0.05)
    cleaned = dict(map(tuple, without_frequent_lines(docs, frequent).collect()))
    assert cleaned[0] == clean[0].split("\n")[0] and cleaned[40] == copies[0]


def brute_frequent(given, line_texts=20, line_share=Fraction(1, 20), left_share=Fraction(1, 5)):
    """(host, text) -> words in lines above the limits, by the stated rule."""
    plain = lambda line: " ".join(re.findall("[^\x20\x09-\x0d]+", re.sub("[0-9]", "0", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line))))
    order = lambda line: hashlib.md5(line.encode()).digest()[:8]
    words = {}
    for host, text in given:
        lines = Counter()
        for line in text.split("\n"):
            if plain(line):
                lines[plain(line)] += len(plain(line).split(" "))
        words[host, text] = lines
    texts = Counter((host, line) for (host, _), lines in words.items() for line in lines)
    keys, having = defaultdict(set), defaultdict(set)
    for (host, text), lines in words.items():
        shared = sorted((line for line in lines if texts[host, line] > line_texts), key=order)
        total = sum(lines.values())
        depleted = shared and total - sum(lines[line] for line in shared) < total * left_share
        key = tuple(shared[:2]) if depleted else text
        keys[host].add(key)
        for line in shared:
            having[host, line].add(key)
    frequent = {(host, line) for (host, line), of in having.items() if len(of) > line_texts and len(of) > line_share * len(keys[host])}
    return {(host, text): sum(n for line, n in lines.items() if (host, line) in frequent) for (host, text), lines in words.items()}


def test_near_copies_count_once(spark):
    """A group of near copies that holds a third of the rows does not reject itself; a notice on other texts is still found."""
    rng = random.Random(6)
    own = lambda words: " ".join(f"u{rng.randrange(10**6)}z" for _ in range(words))
    first = [own(12) for _ in range(12)]
    copies = []
    for at in range(400):
        lines = list(first)
        for _ in range(rng.randint(0, 2)):
            place = rng.randrange(12)
            lines[place] = lines[place] + f" x{at}y"
        copies.append("\n".join(lines))
    notice = " ".join(f"right{chr(97 + at % 26)}{chr(97 + at // 26)}" for at in range(75))
    noted = [own(70) + "\n" + notice for at in range(60)]
    bare = [notice + "\n" + own(4) for _ in range(3)]
    plain = [own(80) for at in range(500)]
    texts = copies + noted + bare + plain
    hosts = [("s", "t")[at % 2] if at < 400 else "s" for at in range(len(texts))]
    result = {row.doc_id: row for row in judge_documents(documents(spark, texts, sources=hosts)).collect()}
    expected = brute_frequent(list(zip(hosts, texts)))
    assert {at: row.n_frequent_words for at, row in result.items()} == {at: expected[hosts[at], text] for at, text in enumerate(texts)}
    assert {at for at, row in result.items() if not row.kept} == {460, 461, 462}


def test_quality_query(spark):
    docs = [(doc[0], doc[1] or "", doc[3] or "") for doc in rows("documents")]
    expected = brute_frequent([(host, text) for _, text, host in docs])
    result = {row.doc_id: row.n_frequent_words for row in QUERIES["op7_quality"](spark, SMALL).collect()}
    assert result == {key: expected[host, text] for key, text, host in docs}


def test_quality_of_unknown_host(spark):
    texts = [" ".join(f"t{at}x{word}" for word in range(60)) for at in range(3)]
    docs = documents(spark, texts, sources=[None, None, "\x00"])
    assert {row.kept for row in judge_documents(docs).collect()} == {True}


def check_shards(given, result, shards):
    assert sorted((row[0], row[1], row[2]) for row in result) == sorted((key, len((text or "").encode()) + 1, zlib.crc32((text or "").encode())) for key, text in given)
    sizes, slots = Counter(), defaultdict(list)
    for row in result:
        sizes[row.shard] += row.size
        slots[row.shard].append(row.slot)
    assert all(sorted(of) == list(range(len(of))) for of in slots.values())
    return [sizes[shard] for shard in range(shards)]


def test_shards_of_odd_rows(spark):
    docs = odd_documents(spark).filter("doc_id is not null")
    check_shards([row for row in odd_rows() if row[0] is not None], shard_documents(docs, 16).collect(), 16)
    assert shard_documents(odd_documents(spark), 4).count() == len(odd_rows())
    assert shard_documents(docs.limit(0), 16).count() == 0
    with pytest.raises(ValueError):
        shard_documents(docs, 12)


def test_shards_are_even_with_ties(spark):
    texts = ["same text"] * 900 + [f"text {at} " * (at % 7) for at in range(300)]
    result = shard_documents(documents(spark, texts), 16).collect()
    sizes = check_shards(list(enumerate(texts)), result, 16)
    assert max(sizes) - min(sizes) <= 8 * max(len(text) for text in texts)


def test_shards_of_repeated_and_extreme_ids(spark):
    """Rows of one id, half of the table, are spread; ids at both ends of 64 bits do not overflow."""
    rows_of = [(7, "w" * 100)] * 300 + [(at * 31, "w" * (at % 9)) for at in range(300)]
    result = shard_documents(spark.createDataFrame([(*row, "s", "en", 1) for row in rows_of], "doc_id long, text string, source string, lang string, n_chars long"), 16).collect()
    sizes = check_shards(rows_of, result, 16)
    assert max(sizes) - min(sizes) <= 4 * 101
    ends = [(-(1 << 63), "a"), ((1 << 63) - 1, "b"), (0, "c"), (-1, "d"), (1, "e")] * 40
    result = shard_documents(spark.createDataFrame([(*row, "s", "en", 1) for row in ends], "doc_id long, text string, source string, lang string, n_chars long"), 16).collect()
    sizes = check_shards(ends, result, 16)
    assert max(sizes) - min(sizes) <= 8


def test_shard_query(spark, tmp_path):
    docs = [(doc[0], doc[1]) for doc in rows("documents")]
    result = QUERIES["op9_kd_shards"](spark, SMALL)
    sizes = check_shards(docs, result.collect(), 16)
    longest = max(len(text.encode()) + 1 for _, text in docs)
    assert max(sizes) - min(sizes) <= 4 * longest
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    write_shards(table, result, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").groupBy("shard").count().count() == len([size for size in sizes if size])


def test_near_copies_keep_their_lines(spark):
    """A near-copy group of a third of the rows, one word changed in each: its own lines are not frequent, a menu still is."""
    rng = random.Random(6)
    own = lambda words: " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(words))
    base = [own(12).split() for _ in range(8)]
    near = []
    for at in range(100):
        lines = [list(line) for line in base]
        lines[at % 8][rng.randrange(12)] = own(1)
        near.append("\n".join(map(" ".join, lines)))
    menu = "home about " + own(60)
    others = [own(60) + "\n" + own(60) + "\n" + menu for _ in range(199)]
    docs = documents(spark, [*near, *others, menu + "\n" + own(5)], sources=["h"] * 300)
    result = {row.doc_id: row for row in judge_documents(docs).collect()}
    assert {key for key, row in result.items() if row.kept} == set(range(299))
    assert {row.n_frequent_words for key, row in result.items() if key < 100} == {0}
    assert {row.n_frequent_words for key, row in result.items() if key >= 100} == {62}
    measured = measure_documents(docs, "doc_id", "text", "source")
    assert frequent_lines(measured).count() == 1
