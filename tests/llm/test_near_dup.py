"""Near duplicates and components against brute force."""

import random

import pytest

from stowline.llm import near_dup
from stowline.llm.components import components
from stowline.llm.near_dup import near_duplicates
from stowline.llm.queries import QUERIES
from tests.llm.common import SMALL, documents, odd_documents, odd_rows, rows


def shingles(text):
    lowered = "".join(chr(ord(one) + 32) if "A" <= one <= "Z" else one for one in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    words = [word for word in lowered.split(" ") if word]
    size = min(5, len(words))
    return {tuple(words[at : at + size]) for at in range(len(words) - size + 1)} if words else set()


def brute(given):
    sets = [(key, shingles(text)) for key, text in given]
    parent = {key: key for key, _ in sets}

    def root(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for at, (key, one) in enumerate(sets):
        for other, two in sets[:at]:
            if one and two and 4 * min(len(one), len(two)) >= 3 * max(len(one), len(two)):
                common = len(one & two)
                if 100 * common >= 75 * (len(one) + len(two) - common):
                    low, high = sorted((root(key), root(other)))
                    parent[high] = low
    return sorted((key, len(one), root(key), root(key) == key) for key, one in sets)


def found(docs):
    return sorted(map(tuple, near_duplicates(docs).collect()), key=repr)


def test_odd_rows(spark):
    expected = brute([row for row in odd_rows() if row[0] is not None]) + [(None, 1, None, True)]
    assert found(odd_documents(spark)) == sorted(expected, key=repr)
    assert found(odd_documents(spark).limit(0)) == []


def test_query(spark):
    result = sorted(map(tuple, QUERIES["op3_near_dup"](spark, SMALL).collect()))
    assert result == brute([(doc[0], doc[1]) for doc in rows("documents")])


def group(seed, copies, edits, size=60):
    """A base text and copies with some words changed, so copies differ from each other more than from the base."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = [base]
    for _ in range(copies):
        copy = list(base)
        begin = rng.randrange(size - edits)
        copy[begin : begin + edits] = [f"x{rng.randrange(10**6)}" for _ in range(edits)]
        out.append(copy)
    return [" ".join(words) for words in out]


@pytest.mark.parametrize("block", [512, 8])
def test_large_group_and_shared_passages(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(5)
    passage = " ".join(f"p{at}" for at in range(40))
    shared = [passage + " " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(14, 60))) for _ in range(60)]
    texts = group(1, 120, 5) + group(2, 2, 2) + shared + [shared[0]] * 30
    rng.shuffle(texts)
    assert found(documents(spark, texts, 100)) == brute(list(enumerate(texts, 100)))


def test_pruning_keeps_pairs_at_the_threshold():
    least = near_dup.least_matches()
    assert list(least) == [32, 64, 96, 128]
    assert all(m < 0.75 * n for n, m in least.items())
    assert least[128] > 0.5 * 128


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + at, 1001 + at) for at in range(40)] + [(5000, 5001 + at) for at in range(50)]
    parent = {}

    def root(node):
        parent.setdefault(node, node)
        while parent[node] != node:
            node = parent[node]
        return node

    for one, other in edges:
        low, high = sorted((root(one), root(other)))
        parent[high] = low
    result = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    alone = {node for node in parent if node not in result}
    assert all(root(node) == node and sum(root(other) == node for other in parent) == 1 for node in alone)
    assert result == {node: root(node) for node in parent if node not in alone}


def test_one_id_with_several_texts(spark):
    """Every text of an id keeps its links, and the id holds them together."""
    rng = random.Random(12)
    one, other = (" ".join(f"{letter}{rng.randrange(10**6)}" for _ in range(300)) for letter in "ab")
    made = [(1, one), (1, other), (2, one + " more"), (3, other + " more"), (4, one), (5, other), (6, "by itself"), (None, one)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    result = {(row.doc_id, row.component_id, row.kept) for row in near_duplicates(docs).collect()}
    assert result == {(1, 1, True), *((at, 1, False) for at in (2, 3, 4, 5)), (6, 6, True), (None, None, True)}
    apart = docs.filter("doc_id <> 1")
    result = {(row.doc_id, row.component_id) for row in near_duplicates(apart).collect()}
    assert result == {(2, 2), (4, 2), (3, 3), (5, 3), (6, 6)}


def test_components_take_few_shuffles(spark, monkeypatch):
    """Edges that are stars already are settled by one stored pass, repeats and self loops among them."""
    from stowline.llm import components as module

    names = []
    monkeypatch.setattr(module, "stored", lambda df, name, real=module.stored: names.append(name) or real(df, name))
    made = [(1, 2), (3, 1), (3, 1), (7, 7), (5, 9), (None, 4)]
    stars = module.stored(spark.createDataFrame(made, "a long, b long"), "given")
    assert dict(map(tuple, components(stars).collect())) == {1: 1, 2: 1, 3: 1, 5: 5, 9: 5}
    assert names == ["given", "least"]


def test_repeated_rows_of_an_id_do_not_store_its_sets(spark, monkeypatch):
    names = []
    monkeypatch.setattr(near_dup, "stored", lambda df, name, real=near_dup.stored: names.append(name) or real(df, name))
    text = " ".join(f"w{at}" for at in range(30))
    assert found(documents(spark, [text, "a b", text + " x"])) == [(0, 26, 0, True), (1, 1, 1, True), (2, 27, 0, False)]
    assert "sets-of-ids" not in names and "repeated-ids" in names
