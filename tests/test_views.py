"""How the derived inputs of the registered queries are stored."""

from __future__ import annotations

from checks import views


def _shuffles(df) -> bool:
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_large_inputs_are_stored_without_a_shuffle(spark):
    many = spark.range(0, 1000, 1, 2 * spark.sparkContext.defaultParallelism)
    assert not _shuffles(views.spread_small(many))


def test_small_inputs_are_dealt_out_to_all_cores(spark):
    few = views.spread_small(spark.range(0, 1000, 1, 1))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(row.id for row in few.collect()) == list(range(1000))


def test_stored_input_of_many_splits_has_no_exchange(spark, tmp_path, monkeypatch):
    """The write itself: what reaches the Parquet writer is not dealt out anew."""
    dealt = []
    plain = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *args: dealt.append(args) or plain(df, *args))

    class Fixed(views.Tables):
        @views.stored
        def rows(self):
            return spark.range(0, 1000, 1, 2 * spark.sparkContext.defaultParallelism)

    assert Fixed(spark, str(tmp_path)).rows().count() == 1000
    assert not dealt
