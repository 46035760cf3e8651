"""Token counts, token files and packing against the tokenizers library itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from stowline.llm.chunks import IdEncoder, id_encoder
from stowline.llm.packing import pack, plan_bins
from stowline.llm.queries import QUERIES
from stowline.llm.token_count import count_tokens, counter
from stowline.llm.token_files import Codec, decode_file, read_files, write_files
from tests.llm.common import SMALL, odd_documents, odd_rows, rows

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


PIECES = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "1", "\x1c", "\x85", "\u3000", ".", "漢", "\u0558", "<|endoftext|>", "½", "\xa0", "\r\n", "😀", "the"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_any_text_like_the_library(text):
    assert list(counter(FILE).count_all([text])) == [len(ids(text))]
    assert np.frombuffer(next(id_encoder(FILE).encode_all([text])), "<u4").tolist() == ids(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=10).map("".join), max_size=6))
def test_texts_of_one_group_do_not_touch(texts):
    assert list(counter(FILE).count_all(texts)) == [len(ids(text)) for text in texts]
    assert [np.frombuffer(one, "<u4").tolist() for one in id_encoder(FILE).encode_all(texts)] == [ids(text) for text in texts]


def test_long_pre_token():
    text = "ab" * 20000
    assert counter(FILE).merger.count(text) == len(ids(text))


def test_counts(spark):
    found = count_tokens(odd_documents(spark), FILE, 1024)
    expected = [(key, len((text or "").encode()), len(ids(text)), len(ids(text)) > 1024) for key, text in odd_rows()]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert count_tokens(odd_documents(spark).limit(0), FILE, 1).count() == 0


def test_count_query(spark):
    found = {row[0]: tuple(row) for row in QUERIES["op2_token_count"](spark, SMALL).collect()}
    assert found == {doc[0]: (doc[0], len(doc[1].encode()), len(ids(doc[1])), len(ids(doc[1])) > 1024) for doc in rows("documents")}


@pytest.mark.parametrize("vocabulary", [300, 65536, 70000, 1 << 25])
def test_codec_round_trip(vocabulary):
    codec = Codec(vocabulary)
    for size in (0, 1, 7, 8, 9, 1000):
        ranks = (np.random.default_rng(size).random(size) ** 4 * vocabulary).astype(np.uint32)
        assert codec.decode(*codec.encode(ranks), size).tolist() == ranks.tolist()


def expected_files(given):
    """Rows of ascending key; rows of one key in any order have the same text here."""
    out, start = [], 0
    for key, text in sorted(given, key=lambda one: (one[0] is not None, one[0])):
        one = [*ids(text), 0]
        out.append((key, start, len(one), crc(one)))
        start += len(one)
    return out


@pytest.mark.parametrize("file_tokens", [1 << 24, 5000])
def test_files(spark, file_tokens):
    manifest, folder = write_files(odd_documents(spark), FILE, 0, file_tokens=file_tokens)
    found = read_files(spark, manifest, folder, "doc_id", "bigint")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected_files(odd_rows()), key=repr)
    decoded = [(key, one.tolist()) for row in manifest.orderBy("file_no").collect() for key, one in decode_file(row.path, folder)]
    assert [key for key, _ in decoded] == [key for key, *_ in expected_files(odd_rows())]
    assert sorted(decoded, key=repr) == sorted(((key, [*ids(text), 0]) for key, text in odd_rows()), key=repr)


def test_no_files(spark):
    manifest, folder = write_files(odd_documents(spark).limit(0), FILE, 0)
    assert read_files(spark, manifest, folder, "doc_id", "bigint").count() == 0


def test_file_query(spark):
    found = sorted(map(tuple, QUERIES["op8_token_files"](spark, SMALL).collect()))
    assert found == expected_files([(doc[0], doc[1]) for doc in rows("documents")])


def check_packing(given, found, capacity=2048):
    texts = defaultdict(list)
    for key, text in given:
        texts[key].append([*ids(text), 0])
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for row in found:
        assert row.ids_crc32 == crc(texts[row.doc_id][0][row.start : row.start + row.length])
        sequences[row.sequence_id].append((row.offset, row.length))
        pieces[row.doc_id].append((row.piece, row.start, row.length))
    for key, of in texts.items():
        size, expected = len(of[0]), []
        first = (size - 1) % capacity + 1
        for piece, begin in enumerate([0, *range(first, size, capacity)]):
            expected.append((piece, begin, first if piece == 0 else capacity))
        assert sorted(pieces[key]) == sorted(expected * len(of))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark):
    found = pack(odd_documents(spark), FILE, 0, 2048).collect()
    check_packing(odd_rows(), found)
    assert pack(odd_documents(spark).limit(0), FILE, 0, 2048).count() == 0


def test_packing_query(spark):
    docs = [(doc[0], doc[1]) for doc in rows("documents")]
    used = check_packing(docs, QUERIES["op10_packing"](spark, SMALL).collect())
    least = -(-sum(len(ids(text)) + 1 for _, text in docs) // 2048)
    assert used <= least * 1.05 + 1


def fewest(items, capacity):
    """Exact number of bins of a small instance, by trying every bin for every item."""
    best = len(items)

    def go(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(items):
            best = len(rooms)
            return
        for place in range(len(rooms)):
            if rooms[place] >= items[at] and rooms[place] not in rooms[:place]:
                go(at + 1, rooms[:place] + [rooms[place] - items[at]] + rooms[place + 1 :])
        go(at + 1, [*rooms, capacity - items[at]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_plans_hold_every_item(items):
    counts = defaultdict(int)
    for item in items:
        counts[item] += 1
    plan = plan_bins(counts, 20)
    placed = defaultdict(int)
    for bins, contents in plan:
        assert bins > 0 and sum(size * each for size, each in contents) <= 20
        for size, each in contents:
            placed[size] += bins * each
    assert placed == counts
    used, best = sum(bins for bins, _ in plan), fewest(sorted(items, reverse=True), 20)
    assert best <= used <= best + 1


def test_one_operator_holds_memory_in_a_worker():
    """What an operator remembered goes when another one's task begins; a running one still ends with right results."""
    from stowline.llm import near_dup
    from stowline.llm.memos import hold

    encoder = id_encoder(FILE)
    texts = ["one two three", "four five " * 200_000, "six seven"]
    hold(encoder.memo)
    running = encoder.encode_all(texts)
    first = next(running)
    assert encoder.memo.young
    near_dup._hold_words()
    near_dup.shingle_set("one two three")
    assert not encoder.memo.young and not encoder.memo.old and near_dup._word_hashes
    assert [np.frombuffer(one, "<u4").tolist() for one in (first, *running)] == [ids(text) for text in texts]
    hold(encoder.memo)
    assert not near_dup._word_hashes


@pytest.mark.parametrize("space", ["\t", "\x0b", "\r", "\x85", "\xa0", "　", " ", " ", "\n"])
def test_white_space_found_like_the_pattern(space):
    from stowline.llm import chunks

    for text in ("", "a", f"a{space}b", f"a{space} b", f"a {space}b", f"{space}a", f"a{space}", f"a{space}\nb", f"a\n{space}b", f"a b\nc{space}d"):
        assert chunks._plain_space(text) == (not chunks._WIDE_SPACE.search(text)), repr(text)


def test_chunks_of_a_group_are_looked_up_once():
    """Repeated words cost no look-up of their own; marks of any kind behind letters give the library's ids."""
    encoder = IdEncoder(FILE)
    texts = [" ".join(["one two, three!?"] * 500), "", None, "x", " lead", "a\nb_ c'' d's naïve###\ne 5% f%% 7th wor-d) (in", "two  wide spaces ", "z" * 50 + "-" * 40 + " q" + "?" * 80]
    seen = []
    values = encoder.memo.values
    encoder.memo.values = lambda chunks: seen.extend(chunks) or values(chunks)
    expected = [np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert list(encoder.encode_all(texts)) == expected == list(encoder.encode_all(texts))
    assert len(seen) < 100
    assert list(encoder.encode_all([None, "", "x"])) == [b"", b"", expected[3]] and list(encoder.encode_all([])) == []


@pytest.mark.parametrize("vocabulary", [50_000, 70_000, 1 << 25])
def test_codes_of_many_documents_like_one_by_one(vocabulary):
    codec, rng = Codec(vocabulary), np.random.default_rng(7)
    documents = [rng.integers(0, rng.choice([10, 300, vocabulary]), size).astype("<u4") for size in (0, 1, 7, 8, 9, 0, 100, 1000)]
    counts = np.array([len(one) for one in documents])
    controls, datas = codec.encode_many(np.concatenate(documents), counts)
    assert list(zip(controls, datas)) == [codec.encode(one) for one in documents]
    assert [len(one) for one in controls] == [-(-size // codec.fields) for size in counts]
    assert codec.decode_many(controls, datas, counts).tolist() == np.concatenate(documents).tolist()
    assert codec.decode(controls[-1], datas[-1], 1000).tolist() == documents[-1].tolist()
    first = documents[-1][0]
    size = max(1, (int(first).bit_length() + 7) // 8)
    assert datas[-1][:size] == int(first).to_bytes(size, "little")
