"""Personal data, filter audit and periodic runs against brute force, planted cases and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowline.llm import pii
from stowline.llm.filter_audit import audit, failure_masks, filter_audit, gray_states, text_mask
from stowline.llm.periodic_runs import collapsed_texts, find_runs, periodic_runs, repeated_tail, words_of
from stowline.llm.queries import ORACLE, QUERIES
from tests.llm.common import SMALL, documents, odd_documents, odd_rows, rows
from tools.compare import rows_of

# ---- personal data -------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_luhn(digits):
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def brute_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match.group())
            good = {
                "email": True,
                "ip": kind == "ip" and max(map(int, match.group().split("."))) <= 255,
                "card": 16 <= len(digits) <= 19 and brute_luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append(f"{kind}:{match.start()}:{match.end()}")
    return found


def assert_base(result, given):
    got, expected = [], []
    for row in result.collect():
        got.append((row.doc_id, row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256))
        listed = [span.split(":") for span in row.spans.split(",") if span]
        assert listed == sorted(listed, key=lambda span: (pii.KINDS.index(span[0]), int(span[1])))
    for key, text in given:
        spans = brute_spans(text)
        counts = Counter(span.split(":")[0] for span in spans)
        expected.append((key, *(counts[kind] for kind in pii.KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(expected, key=repr)


TRICKY = [
    "a@b.c.d@e.f x", "a@b.c_d@e.f", "a@b..c a@b.c..d", "é\U0001f600 +1 (017) 555-7713 1.2.3.4.5.6.7.8",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 4111111111111111", "1.2.3.256 0001.2.3.4 1.2.3.0000000255 99999999999999999999999.1.1.1",
    "+1 +2(34567890) ++49 30 1234567-", "1 " * 30, "4111111111111111 34", "@a.b .@a.b", "x@y.z" * 3, "\x00\x01 a@b.c\x00",
]


def test_base_spans(spark):
    rng = random.Random(3)
    pieces = ["a", "1", "4", "11", ".", "-", " ", "@", "+", "(", ")", "é", "255", "300", "\n", "\U0001f600", "x.y", ".com", " 4111111111111111 "]
    texts = TRICKY + ["".join(rng.choices(pieces, k=rng.randint(1, 120))) for _ in range(300)]
    texts.append("4111111111111111 a@b.c " * 600)  # more spans than one block of sums
    docs = odd_documents(spark).union(documents(spark, texts, 100)).withColumn("spans", F.lit(1)).withColumn("n_ip", F.lit(2))
    assert_base(pii.personal_data(docs), [*odd_rows(), *enumerate(texts, 100)])


def test_personal_data_of_nothing(spark):
    spans = pii.candidates(documents(spark, ["no such thing", None]))
    model = pii.fit(spans)
    assert {(row.n_email, row.spans) for row in pii.judge_spans(spans, model).collect()} == {(0, "")}
    assert pii.judge_spans(spans.limit(0), model).count() == 0


def test_personal_data_query(spark):
    assert_base(QUERIES["op11_pii"](spark, SMALL), [(doc[0], doc[1]) for doc in rows("documents")])


def test_learned_spans(spark):
    """Planted spans outside the base are found, look-alikes are left; reliabilities follow the truth."""
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def card():
        body = "4" + digits(14)
        return next(body + last for last in "0123456789" if brute_luhn(body + last))

    yes = [
        lambda: f"mail bob{digits(2)} [at] example [dot] com today",
        lambda: f"contact ann.{digits(2)} (at) mail.org please",
        lambda: f"write to x{digits(3)}@mail.com now",
        lambda: f"call +1 (415) 555-{digits(4)} now",
        lambda: f"card {card()} was charged",
        lambda: f"from 10.{rng.randrange(255)}.{rng.randrange(255)}.7 came",
    ]
    no = [
        lambda: f'token = "a{digits(16)}f" stays',
        lambda: f"order 9{digits(14)}x shipped",
        lambda: f"version 300.{digits(2)}.1.{digits(3)} is out",
        lambda: "the rest is prose without a span",
    ]
    texts, truth = [], []
    for at in range(600):
        good = at % 2 == 0
        texts.append("some words " + rng.choice(yes if good else no)())
        truth.append(good)
    spans = pii.candidates(documents(spark, texts[:400]))
    model = pii.fit(spans)
    held = {row.doc_id: row for row in pii.judge_spans(pii.candidates(documents(spark, texts)), model).collect()}
    right = sum((held[at].spans != "") == truth[at] for at in range(400, 600))
    assert right >= 195
    spelled = [at for at in range(400, 600) if "[dot]" in texts[at] or "(at)" in texts[at]]
    assert spelled and sum(held[at].spans.startswith("email:") for at in spelled) >= 0.9 * len(spelled)
    assert all(held[at].n_email == 0 for at in spelled)
    around = model.labelers["card"].yes[pii.LABELERS.index("around")]
    assert around[1] > 0.9 > 0.1 > model.labelers["card"].no[pii.LABELERS.index("around")][1]
    masked = {row.doc_id: row.text for row in pii.masked_texts(documents(spark, [texts[400], None, "a@b.co, 10.0.0.1!"]), model).collect()}
    assert masked[1] is None and masked[2] == "[email], [ip]!"


def test_estimate_recovers_reliabilities():
    rng = random.Random(8)
    shares = [(0.9, 0.2), (0.7, 0.1), (0.8, 0.4)]
    counts = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.3
        counts[tuple(int(rng.random() < share[not good]) for share in shares)] += 1
    found = pii.estimate(dict(counts), 400)
    assert abs(found.prior - 0.3) < 0.06
    for at, (yes, no) in enumerate(shares):
        assert abs(found.yes[at][1] - yes) < 0.08 and abs(found.no[at][1] - no) < 0.08


# ---- filter audit --------------------------------------------------------------


def brute_mask(key, text, given):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    mask = int(len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
    mask += 8 * bool(re.search("[#$%&*|]", text))
    return mask + 16 * any(other is not None and key is not None and other < key and (one or "") == text for other, one in given)


def brute_audit(cells):
    """By going through all orders document by document; `cells` holds (mask, good, toxic)."""
    out, sums = [], Counter()
    for order in permutations("ABCDE"):
        left = list(cells)
        for step, name in enumerate(order, 1):
            bit = 1 << "ABCDE".index(name)
            gone = [cell for cell in left if cell[0] & bit]
            left = [cell for cell in left if not cell[0] & bit]
            failing = sum(1 for cell in cells if cell[0] & bit)
            alone = sum(1 for cell in cells if cell[0] == bit)
            out.append(["".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(c[1] for c in gone), sum(c[2] for c in gone)])
            sums[name] += len(gone)
    return sorted((*row, sums[row[0][row[1] - 1]]) for row in out)


def test_audit_of_masks():
    rng = random.Random(4)
    for size in (0, 1, 40):
        documents_of = [(rng.randrange(32), rng.randrange(2), rng.randrange(2)) for _ in range(size)]
        cells = defaultdict(lambda: [0, 0, 0])
        for mask, good, toxic in documents_of:
            for at, value in enumerate((1, good, toxic)):
                cells[mask][at] += value
        if size:
            assert sorted(audit([(mask, tuple(counts)) for mask, counts in cells.items()])) == brute_audit(documents_of)
            states = gray_states([(mask, tuple(counts)) for mask, counts in cells.items()])
            assert [state[0] for state in states] == [sum(1 for cell in documents_of if not cell[0] & subset) for subset in range(32)]


def test_audit_of_tables(spark):
    texts = ["one two", "one two", None, "", "A B " * 150, "w%d " * 250 % tuple(range(250)), "lower words " * 120 + "#", "one two"]
    docs = documents(spark, texts, 50).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.lit("en"))).withColumn("mask", F.lit(1)).withColumn("n", F.lit(1))
    docs = docs.union(docs.filter("doc_id = 51")).union(odd_documents(spark).withColumn("mask", F.lit(1)).withColumn("n", F.lit(1)))
    labels = spark.createDataFrame([(50, 1, 0, "x"), (50, 0, 1, "x"), (51, None, 1, "x"), (5, 1, 1, "x"), (None, 1, 1, "x"), (999, 1, 1, "x")], "doc_id long, quality int, toxic int, part string")
    given = [(row.doc_id, row.text, row.lang or "") for row in docs.collect()]
    good, toxic = {50, 5}, {50, 51, 5}
    parts = defaultdict(list)
    for key, text, part in given:
        parts[part].append((brute_mask(key, text, [(one, of) for one, of, _ in given]), int(key in good), int(key in toxic)))
    expected = sorted((part, *row) for part, cells in parts.items() for row in brute_audit(cells))
    result = filter_audit(docs, labels)
    assert result.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, result.collect())) == expected
    assert filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
    assert failure_masks(docs).count() == len(given)
    assert text_mask(None) == 1


def test_audit_query(spark):
    import duckdb

    base = duckdb.connect()
    for name in ("documents", "labels"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    cursor = base.execute(ORACLE["op12_filter_audit"])
    result = QUERIES["op12_filter_audit"](spark, SMALL)
    columns = [item[0] for item in cursor.description]
    assert rows_of(result.columns, [tuple(row) for row in result.collect()]) == rows_of(columns, cursor.fetchall())


# ---- periodic runs -------------------------------------------------------------


def brute_runs(words):
    found = {}
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            begin = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            if at - begin >= period:
                found.setdefault((begin, at - begin + period), period)
            at += 1
    return sorted((begin, length, period) for (begin, length), period in found.items() if length >= 12)


def brute_facts(key, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in sorted(runs, key=lambda run: (run[0], run[2])))
    best = min(runs, key=lambda run: (-run[1], run[0], run[2])) if runs else (None, None, None)
    dropped = {at for start, length, period in runs for at in range(start + period, start + length)}
    kept = " ".join(word for at, word in enumerate(words) if at not in dropped)
    milli = 1000 * best[1] // best[2] if runs else None
    return key, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def words_at_random(rng):
    n, letters = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 4])
    if rng.random() < 0.5:
        return [rng.randrange(letters) for _ in range(n)]
    words = []
    while len(words) < n:
        words += (([rng.randrange(letters) for _ in range(rng.randint(1, 12))]) * rng.randint(1, 6))[: rng.randint(1, 60)]
    return words


def fibonacci(n):
    one, other = [0], [0, 1]
    while len(other) < n:
        one, other = other, other + one
    return other[:n]


def test_runs_of_words():
    rng = random.Random(1)
    for _ in range(1500):
        docs = [words_at_random(rng) for _ in range(rng.randint(1, 4))]
        sizes = [len(words) for words in docs]
        codes = np.array([word for words in docs for word in words], np.int64)
        owner, stop = np.repeat(np.arange(len(docs)), sizes), np.repeat(np.cumsum(sizes), sizes)
        expected, first = [], 0
        for words in docs:
            expected += [(start + first, length, period) for start, length, period in brute_runs(words)]
            first += len(words)
        assert find_runs(codes, owner, stop) == sorted(expected)


@pytest.mark.parametrize("words", [fibonacci(600), [0] * 400, [0, 1] * 200, ([0] * 19 + [1]) * 20, [0, 0, 1, 0, 0, 1, 0, 0] * 30])
def test_runs_of_repetitive_words(words):
    size = len(words)
    assert find_runs(np.array(words), np.zeros(size, np.int64), np.full(size, size)) == brute_runs(words)


def test_periodic_runs(spark):
    rng = random.Random(9)
    texts = [" ".join("ab c\x00 d"[word : word + 2].strip() or "e" for word in words_at_random(rng)) for _ in range(300)]
    docs = odd_documents(spark).union(documents(spark, texts, 100)).withColumn("start", F.lit("x")).withColumn("n_runs", F.lit("x"))
    given = [*odd_rows(), *enumerate(texts, 100)]
    given = [(key, "word" if text and text.startswith("word word") else text) for key, text in given]  # tested by itself below
    result = [tuple(row) for row in periodic_runs(docs.withColumn("text", F.when(F.col("text").startswith("word word"), F.lit("word")).otherwise(F.col("text")))).collect()]
    assert sorted(result, key=repr) == sorted((brute_facts(key, text) for key, text in given), key=repr)
    assert any(row[1] for row in result) and sum(repeated_tail(key, 9) is not None for key, _ in given) > 10
    assert periodic_runs(docs.limit(0)).count() == 0


def test_long_run(spark):
    docs = documents(spark, ["word " * 1_000_000, "a b " * 300_000 + "a c d"], 1)
    long, mixed = sorted(map(tuple, periodic_runs(docs).collect()))
    assert long[1:6] == (1, 0, 1_000_000, 1, 1_000_000_000) and long[7] == hashlib.sha256(b"word").hexdigest()
    assert mixed[1:6] == (1, 0, 600_001, 2, 300_000_500) and mixed[7] == hashlib.sha256(b"a b c d").hexdigest()


def test_collapsed_texts(spark):
    docs = documents(spark, ["x  " + "a b c " * 5 + "y", None, ""])
    result = sorted(map(tuple, collapsed_texts(docs).collect()))
    assert result == [(0, "x a b c y", [(1, 15, 3)]), (1, None, []), (2, "", [])]
    assert words_of(None) == []


def test_periodic_query(spark):
    result = sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, SMALL).collect()), key=repr)
    assert result == sorted((brute_facts(doc[0], doc[1]) for doc in rows("documents")), key=repr)
