"""Small tables with the odd rows that every operator must take."""

from __future__ import annotations

import duckdb

SMALL = "/root/testdata/sf0.001"
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "one two three four", "one two three four five", "One TWO three four five", "é" * 3000,
    "word " * 5000, "<|endoftext|> x <|endoftext|>", "a\u00a0b\u2003c d", "tab\tand\x0bother\x0cspace\r\nend", "12 % # * $ & | < > 12 % # *",
    "don't  stop   now \n  x", "\U0001f600 \u6f22\u5b57 \u0558 \u00bd", "x" * 70000,
]


def rows(name: str, folder: str = SMALL) -> list[tuple]:
    return duckdb.connect().execute(f"SELECT * FROM '{folder}/{name}.parquet'").fetchall()


def documents(spark, texts, first: int = 0, sources=None):
    """Documents with extra columns whose names clash with results."""
    sources = sources or ["s"] * len(texts)
    made = [(first + at, text, "en", source, 7, 1, "x", 2) for at, (text, source) in enumerate(zip(texts, sources))]
    return spark.createDataFrame(
        made, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, kept string, shard int"
    )


def odd_documents(spark):
    """All odd texts, repeated rows, and a row without id, language and source."""
    docs = documents(spark, ODD_TEXTS)
    lost = spark.createDataFrame([(None, "lost row", None, None, None, None, None, None)], docs.schema)
    return docs.union(docs.filter("doc_id = 6")).union(lost)


def odd_rows() -> list[tuple]:
    return [*enumerate(ODD_TEXTS), (6, ODD_TEXTS[6]), (None, "lost row")]
