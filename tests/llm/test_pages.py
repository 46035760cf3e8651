"""URL filter, WARC archives and main text."""

import hashlib
import html as entities
import re
import time
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from stowline.llm import url_filter
from stowline.llm.html_text import RUN, blocks_of, extract_host, extract_text, opened_slots, packed_slots, repeated_tokens
from stowline.llm.queries import QUERIES, URL_RULES
from stowline.llm.warc import archived_pages, chunk_table, plan_records, read_chunks, write_archives
from tests.llm.common import SMALL, rows

ODD_URLS = [
    None, "", "no scheme", "http://", "http://A.COM", "https://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/1", "http://a.b.example.com/en/", "http://example.com?/en/",
    "http://badexample.com/en/1", "x://y.net/es/9://z", "http://a.net/fr", "http://a.net/fr/#", "http://É.com/p q", "http://h.org/" + "a/" * 3000, "http://h.org/1?a=1&b=2",
]


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(one) + 32) if "A" <= one <= "Z" else one for one in host), path


def brute_rule(host, path):
    fits = []
    for rule, verdict in URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    urls = spark.createDataFrame([(at, url, "x") for at, url in enumerate(ODD_URLS)], "page_id long, url string, verdict string")
    model = url_filter.fit(url_filter.labelled_by_rules(urls, URL_RULES))
    for row in url_filter.judge_urls(urls, URL_RULES, model).collect():
        host, path = split_url(ODD_URLS[row.page_id])
        rule, verdict = brute_rule(host, path)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict or rule is None and row.verdict in ("allow", "block")
    assert url_filter.judge_urls(urls.limit(0), URL_RULES, model).count() == 0


@pytest.mark.parametrize("labels, score", [([], 0.0), ([1, 1], 1.0), ([0, None], 0.0)])
def test_too_few_labels(spark, labels, score):
    labelled = spark.createDataFrame([(f"http://a.b/{at}", label) for at, label in enumerate(labels)], "url string, blocked int")
    model = url_filter.fit(labelled)
    urls = spark.createDataFrame([(1, "http://c.d/")], "page_id long, url string")
    assert url_filter.judge_urls(urls, [], model).first().score == score


def test_repeated_urls_are_weights(spark):
    """A URL that holds half of all rows is drawn once; its rows all count in the statistics."""
    rows_of = [("http://hot.net/x?a=1", 1)] * 600 + [(f"http://h{at}.com/p/{at}", 0) for at in range(300)] + [(f"http://b{at}.net/fr/{at}", 1) for at in range(300)]
    labelled = spark.createDataFrame(rows_of, "url string, blocked int").repartition(4)
    model = url_filter.fit(labelled, train_rows=200)
    assert model.base == 900 / 1200
    assert {row["n"] for row in model.statistics.groupBy("name").sum("n").toDF("name", "n").collect()} == {1200.0}
    assert model.scored(labelled, "url").selectExpr("avg(int((score >= 0.5) = (blocked = 1)))").first()[0] > 0.95


def test_held_out_accuracy(spark):
    """Trees trained on one half of the labelled urls, judged on the other."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = url_filter.labelled_by_rules(pages, URL_RULES)
    held = "pmod(xxhash64('half', url), 2) = 0"
    model = url_filter.fit(labelled.filter(f"not {held}"))
    right = model.scored(labelled.filter(held), "url").selectExpr("avg(int((score >= 0.5) = (blocked = 1))) as a", "avg(blocked) as b").first()
    assert right.a > max(0.9, right.b, 1 - right.b)


def test_url_query(spark):
    result = {row.page_id: row for row in QUERIES["op1_url_filter"](spark, SMALL).collect()}
    pages = rows("pages")
    assert len(result) == len(pages)
    for page_id, url, _ in pages:
        rule, verdict = brute_rule(*split_url(url))
        assert (result[page_id].host, result[page_id].path) == split_url(url)
        assert result[page_id].rule == rule and (rule is None or result[page_id].verdict == verdict)


LONG = "é<p>\r\n\r\n" * 400
ODD_PAGES = [(1, "u1", None), (2, None, ""), (3, "u 3\r\nX: y", "short"), (4, "u4", "short"), (5, "u5", LONG), (6, "u6", LONG), (7, "u7", LONG + "x"), (8, "u8", "z" * 300_000), (7, "u7", LONG + "x")]


def brute_records(pages):
    first = defaultdict(int)
    for page_id, _, html in pages:
        first[html] = max(first[html], page_id)
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        again = len(payload) >= 1000 and first[html] != page_id
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=repr)


def odd_pages(spark):
    return spark.createDataFrame([(*page, "x") for page in ODD_PAGES], "page_id long, url string, html string, record_type string")


def test_archives(spark):
    result = archived_pages(odd_pages(spark))
    assert sorted(map(tuple, result.collect()), key=repr) == brute_records(ODD_PAGES)
    assert archived_pages(odd_pages(spark).limit(0)).count() == 0
    manifest = write_archives(plan_records(odd_pages(spark)))
    parts = defaultdict(list)
    for row in chunk_table(manifest).filter("record_id = '8' or record_id = '6'").collect():
        parts[row.record_id].append(row)
    for name, html in (("8", ODD_PAGES[7][2]), ("6", LONG)):
        chunks = sorted(parts[name], key=lambda row: row.chunk_no)
        assert b"".join(row.chunk for row in chunks).decode() == html
        assert [row.last for row in chunks] == [False] * (len(chunks) - 1) + [True]
        held = hashlib.sha1()
        for row in chunks:
            held.update(row.chunk)
            assert row.sha1_so_far == held.hexdigest()
    assert len(parts["8"]) == 5
    small = [row for path in manifest.collect() for row in read_chunks(path.path, 10) if row[0] == "3"]
    assert small[0][1] == "u%203%0D%0AX:%20y"


def test_archives_of_pages_without_id(spark):
    pages = spark.createDataFrame([(None, "a", LONG), (None, "b", LONG)], "page_id long, url string, html string")
    assert [(row.page_id, row.record_type) for row in archived_pages(pages).collect()] == [(None, "response")] * 2


def test_blocks():
    page = "<body class='x'><p>a &lt;b&gt; <i>c</i>d<p>e<div class='no-sidebar'>f<nav>x</div>g<div id=cookie-notice>n<div>m</div></div>h<!-- c --><script>'<p>'</script> i <b"
    assert [text for zone, text in blocks_of(page) if zone == "open"] == ["a <b> cd", "e", "f", "g", "h i"]
    article = "<nav>m</nav><article><header>t</header><h1>T&amp;</h1><p>one\n two<br>three<form>f</form><section class='comments'><article>c</article></section></article><footer>z"
    assert [text for zone, text in blocks_of(article) if zone == "article"] == ["T&", "one two", "three"]
    assert blocks_of("") == [] and blocks_of("plain < text") == [("open", "plain < text")]


@pytest.mark.parametrize("form", ["<a ", '<a "', "<a '\"", "<a", "<", "<!--", "<a href='x\" "])
@pytest.mark.parametrize("tail", ["", ">", '">', "'>"])
def test_tags_that_never_end(form, tail):
    """Time is in proportion to the page: eight times the page takes no more than some 8 times as long."""
    took = []
    for size in (100_000, 800_000):
        begin = time.process_time()
        blocks_of("<p>before<p>" + form * (size // len(form)) + tail)
        took.append(time.process_time() - begin)
    assert took[1] < 24 * took[0] + 0.3
    assert blocks_of("<p>before<p>" + form)[0] == ("open", "before")


def test_markup_after_an_open_tag():
    assert blocks_of("<p>a<p>b <i 'c <nav>d</nav><p>e") == [("open", "a"), ("open", "b <i 'c"), ("chrome", "d"), ("open", "e")]
    assert blocks_of("<p title='>' class=x>a<b\"c'>'\">d") == [("open", "ad")]


def test_article_sections_named_like_furniture_stay():
    kept = ["<section id='related-work'>one</section>", "<figure id='header-image'>two</figure>", "<div class='signup-rates'>three</div>", "<p class='comments-on-the-law'>four"]
    gone = ["<div class='comments'>x</div>", "<div class='social-share'>x</div>", "<aside>x</aside>", "<div id='newsletter'>x</div>", "<div role='search'>x</div>"]
    page = "<article>" + "".join(kept + gone) + "</article><div class='signup-rates'>x</div>"
    assert [text for zone, text in blocks_of(page) if zone == "article"] == ["one", "two", "three", "four"]


def test_repeated_runs():
    rng = np.random.default_rng(1)
    for _ in range(100):
        pages = [rng.integers(0, 3, rng.integers(0, 40)).tolist() for _ in range(rng.integers(1, 5))]
        expected = []
        for at, page in enumerate(pages):
            marked = [False] * len(page)
            for begin in range(len(page) - RUN + 1):
                run = page[begin : begin + RUN]
                if any(run == other[i : i + RUN] for it, other in enumerate(pages) if it != at for i in range(len(other))):
                    marked[begin : begin + RUN] = [True] * RUN
            expected += marked
        stream = np.array([token for page in pages for token in page], np.int64)
        found = repeated_tokens(stream, np.repeat(np.arange(len(pages)), [len(page) for page in pages]))
        assert len(stream) < 2 * RUN or found.tolist() == expected


def test_open_pages_keep_unique_runs():
    """Without an article, what the host's pages repeat goes and unique runs stay."""
    menu = "welcome to our site please read all of this menu"
    pages = pd.DataFrame({"page_id": [1, 2], "url": ["u", "u"], "_html": [f"<div>{menu}</div><p>first own text</p>", f"<div>{menu}</div><p>second</p>"]})
    assert extract_host(pages, "page_id", "url")["text"].tolist() == ["first own text", "second"]


def test_odd_pages(spark):
    result = {(row.page_id, row.text, row.n_chars) for row in extract_text(odd_pages(spark)).collect()}
    assert (1, "", 0) in result and (2, "", 0) in result and (3, "short", 5) in result
    assert extract_text(odd_pages(spark)).count() == len(ODD_PAGES)
    assert extract_text(odd_pages(spark).limit(0)).count() == 0


def test_text_query(spark):
    """On the given pages the article is one plain element; cut it out and compare."""
    result = {row.page_id: row for row in QUERIES["op5_html_text"](spark, SMALL).collect()}
    for page_id, url, html in rows("pages"):
        body = re.search(r"<article>(.*?)(</article>|\Z)", html, re.S)[1]
        parts = (" ".join(entities.unescape(re.sub("</?b>", "", part)).split()) for part in re.split("</?(?:p|h1|br)>", body))
        text = " ".join(part for part in parts if part)
        assert (result[page_id].url, result[page_id].text, result[page_id].n_chars) == (url, text, len(text))


def test_parts_of_a_host_like_the_whole(spark, monkeypatch):
    """Runs on two or more pages of a host are found wherever its parts lie; copies of a page are one page."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{one}" for one in rng.integers(0, 10**6, n))
    quotes = [words(10) for _ in range(20)]
    htmls = [f"<div>{words(12)}</div><p>{quotes[at % 20]}</p><p>{words(9)}</p>" for at in range(40)]
    htmls += [f"<article>{quotes[at]} {words(5)}</article>" for at in range(5)]
    htmls += [f"<p>{words(30)}</p>"] * 6 + ["short"] * 3
    made = [(at, f"http://h.org/{at}", html) for at, html in enumerate(htmls)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    whole = extract_host(pd.DataFrame(made, columns=["page_id", "url", "_html"]), "page_id", "url")
    expected = {row.page_id: (row.text, row.n_repeated_words) for row in whole.itertuples()}
    assert all(quote not in text for quote in quotes for text, _ in list(expected.values())[:40])
    assert [expected[at][1] for at in range(40, 45)] == [10] * 5
    assert {expected[at][0] for at in range(45, 51)} == {htmls[45][3:-4]}
    for size in (2, 20):
        monkeypatch.setattr("stowline.llm.html_text.PART_PAGES", size)
        assert {row.page_id: (row.text, row.n_repeated_words) for row in extract_text(pages).collect()} == expected


def test_copied_page_without_article():
    """The same html under two urls keeps its text."""
    text = "one two three four five six seven eight nine ten"
    pages = pd.DataFrame({"page_id": [1, 2], "url": ["http://h/a", "https://h/a"], "_html": [f"<p>{text}</p>"] * 2})
    assert extract_host(pages, "page_id", "url")["text"].tolist() == [text, text]


def test_pages_are_not_shuffled(spark, monkeypatch):
    """Runs on pages of several batches and tasks are found although no page leaves the task that reads it."""
    rng = np.random.default_rng(11)
    words = lambda n: " ".join(f"w{one}" for one in rng.integers(0, 10**6, n))
    quotes = [words(9) for _ in range(12)]
    htmls = [f"<p>{words(5)} {quotes[at % 12]} {words(int(rng.integers(0, 20)))}</p>" for at in range(36)]
    htmls += [f"<article>{words(3)} {quotes[0]}</article>", None, "", f"<p>{words(40)}</p>"] + [f"<p>{words(10)}</p><nav>{quotes[3]}</nav>"] * 5 + ["<p>a b"] * 3
    made = [(at, f"http://{'g' if at % 9 == 8 else 'h'}.org/{at}", html) for at, html in enumerate(htmls)]
    expected = {}
    for host in "gh":
        some = pd.DataFrame([row for row in made if row[1][7] == host], columns=["page_id", "url", "_html"])
        expected |= {row.page_id: (row.text, row.n_repeated_words) for row in extract_host(some, "page_id", "url").itertuples()}
    assert expected[36][1] == 9
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows_of_batch, chars in ((1, 1000), (3, 1 << 24), (1000, 400), (1000, 1 << 24)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_of_batch)
            monkeypatch.setattr("stowline.llm.html_text.BATCH_CHARS", chars)
            for given in (pages, pages.repartition(3)):
                found = extract_text(given)
                assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
                assert {row.page_id: (row.text, row.n_repeated_words) for row in found.collect()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_pages_read_differently_are_refused(spark):
    pages = spark.range(40).selectExpr("id as page_id", "'u' as url", "concat('<p>a b c d e f g h ', uuid()) as html")
    with pytest.raises(Exception, match="not read alike twice"):
        extract_text(pages.selectExpr("page_id", "url", "concat(html, current_timestamp(), rand()) as html")).collect()


@pytest.mark.parametrize("count, width", [(0, 10), (1, 1), (1, 1 << 40), (500, 500), (500, 3000), (5000, 1 << 40)])
def test_packed_slots(count, width):
    slots = np.array(sorted({at * (width // max(1, count)) for at in range(count)}), np.uint64)
    block = packed_slots(slots, width)
    assert opened_slots(block).tolist() == slots.tolist()
    assert len(block) <= 5 + 2 + len(slots) * (4 + max(0, width // max(1, count)).bit_length()) / 8 + 1
