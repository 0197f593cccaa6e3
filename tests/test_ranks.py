"""Joins of many rows with few keys."""

from pyspark.sql import functions as F

from logweir.functions import ranks


def test_only_keys_of_very_many_rows_are_copied(spark, monkeypatch):
    """A key is there once, one of more than HOT rows once per salt; nothing that grows with the keys is broadcast."""
    monkeypatch.setattr(ranks, "HOT", 50)
    rows = spark.range(1000).select("id", F.when(F.col("id") < 500, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"))
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k <> 'k7'")
    for how in ("inner", "left", "left_semi"):
        out = ranks.salted_join(rows, counts.withColumn("name", F.upper("k")), "k", how, ["id"], "n")
        want = {r.id for r in rows.collect() if how == "left" or r.k != "k7"}
        got = out.collect()
        assert len(got) == len(want) and {r.id for r in got} == want and out.columns == ["k", "id"] + ["name"] * (how != "left_semi")
        if how != "left_semi":
            assert all(r.name == (None if r.k == "k7" else r.k.upper()) for r in got)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("strategy=broadcast") == 1 and "strategy=merge" in plan
