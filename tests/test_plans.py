"""Shared plan parts."""

from pyspark.sql import functions as F

from trovelens.plans import skew


def test_skewed_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 50)
    many = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("k"))
    one = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, many.join(one, ["k"], how).collect()), key=repr)
        got = skew.skewed_join(many, one, ["k"], how)
        assert sorted(map(tuple, got.collect()), key=repr) == want and got.columns == many.join(one, ["k"], how).columns
    want = sorted(map(tuple, many.join(one, ["k"]).collect()))
    assert sorted(map(tuple, skew.skewed_join(many.repartition(3), one, ["k"], sizes=many.groupBy("k").agg(F.count("id").alias("n")), spread=["id"]).collect())) == want
    assert skew.skewed_join(many.limit(0), one, ["k"]).count() == 0


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(1000).select(F.concat(F.lit("p"), F.lpad((F.col("id") * 37 % 1000).cast("string"), 4, "0")).alias("p")).repartition(7)
    got = skew.numbered(df, "p", "n").orderBy("p").collect()
    assert [r.n for r in got] == list(range(1, 1001))
    assert skew.numbered(df.limit(0), "p", "n").count() == 0
