"""Ranks over ranges: groups, nulls, ties, empty tables, a group that holds most rows."""

from pyspark.sql import functions as F

from provmart.operators.ranks import ranked


def test_ranks_within_groups_of_any_size(spark):
    hot = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 > 0, (F.col("id") % 7).cast("string"))
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), hot.alias("g"), F.lit(9).alias("idx"))
    got = ranked(rows, ["k"], ["g"], range_rows=60).toPandas()
    assert list(got.columns) == ["k", "g", "idx", "n"] and len(got) == 1000
    for _, x in got.groupby("g", dropna=False):
        assert list(x.sort_values("k").idx) == list(range(len(x))) and (x.n == len(x)).all()


def test_ranks_of_a_whole_table_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([(None,), ("b",), ("a",), (None,), ("b",)], "k string")
    got = ranked(rows, [F.col("k").asc_nulls_first()], range_rows=2).orderBy("idx").collect()
    assert [(r.k, r.idx, r.n) for r in got] == [(None, 0, 5), (None, 1, 5), ("a", 2, 5), ("b", 3, 5), ("b", 4, 5)]
    assert not ranked(rows.where("false"), ["k"]).count()
