"""The pipeline's stages, one after another."""

import corpus_pipeline
from stowline.llm.quality import judge_documents
from tests.llm.common import SMALL, documents, rows
from tests.llm.test_documents import brute_hits
from tests.llm.test_near_dup import brute
from tests.llm.test_tokens import check_packing


def test_stages_like_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {row.doc_id for row in judge_documents(docs).filter("kept").collect()}
    given = [(doc[0], doc[1]) for doc in rows("documents") if doc[0] in good]
    firsts = {key for key, _, _, kept in brute(given) if kept}
    given = [doc for doc in given if doc[0] in firsts]
    clean = {row[0] for row in brute_hits(given, rows("benchmark")) if not row[5]}
    given = [doc for doc in given if doc[0] in clean]
    check_packing(given, corpus_pipeline.run(spark, SMALL).collect())


def test_stages_return_documents(spark):
    docs = documents(spark, [None, "", "a b c", " ".join(f"w{at}" for at in range(70))] * 2)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns
        docs = kept
    assert [row.doc_id for row in docs.collect()] == [3]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def _page(name: str) -> str:
    return " ".join(f"{name}{at}" for at in range(70))


def test_rows_are_judged_for_their_own_texts(spark):
    """Rows without an id and rows that share an id stay or go by themselves; clashing column names do no harm."""
    good, other = _page("g"), _page("o")
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, row_ string, kept string"
    rows = [(1, "bad"), (1, good), (None, other), (None, "bad"), (2, None), (3, _page("p")), (3, _page("q"))]
    docs = spark.createDataFrame([(key, text, "en", "s", 1, 2, "x", "y") for key, text in rows], schema)
    kept = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted((row.doc_id or 0, row.text) for row in kept.collect()) == [(0, other), (1, good), (3, _page("p")), (3, _page("q"))]


def test_one_row_of_a_group_stays(spark):
    text, lone, copied = _page("a"), _page("b"), _page("c")
    schema = "doc_id long, text string, lang string, source string, row int"
    rows = [(9, text), (None, text + " more"), (4, text), (4, text), (None, lone), (None, copied), (None, copied), (5, None), (6, "")]
    docs = spark.createDataFrame([(key, one, "en", "s", 1) for key, one in rows], schema).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert kept.columns == docs.columns
    found = sorted((row.doc_id or 0, row.text or "") for row in kept.collect())
    assert found == [(0, lone), (0, copied), (4, text), (5, ""), (6, "")]


def test_contaminated_rows_go_alone(spark):
    passage = next(row[1] for row in rows("benchmark") if row[1] and len(row[1].split()) >= 10)
    schema = "doc_id long, text string, row int"
    docs = spark.createDataFrame([(1, "x " + passage, 1), (1, "clean", 1), (None, "clean too", 1), (None, passage, 1)], schema)
    kept = corpus_pipeline.decontamination(spark, docs, SMALL).collect()
    assert sorted((row.doc_id or 0, row.text) for row in kept) == [(0, "clean too"), (1, "clean")]


def test_texts_travel_in_small_batches(spark, tmp_path):
    """Every stage bounds the texts that a task holds at once; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    try:
        for given, wanted in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("7", 7)):
            for begin in (corpus_pipeline._numbered, lambda rows: corpus_pipeline.packing(spark, rows, str(tmp_path))):
                spark.conf.set(name, given)
                begin(docs)
                assert int(spark.conf.get(name)) == wanted
    finally:
        spark.conf.set(name, before)
