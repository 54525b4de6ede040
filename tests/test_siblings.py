"""Siblings are counted from figures of their parent, without pairs."""

import random

from pyspark.sql import functions as F

from evidentia.operators import tree


def test_counts_equal_counted_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"n{rng.randint(0, 30)}", rng.choice([None, "a", "b", "c", "d"])) for _ in range(80)] + [("only", "e"), ("twice", "f"), ("twice", "f"), (None, "a")]
    t = spark.createDataFrame(rows, "node_id string, parent_id string")
    want = sorted(map(tuple, tree.siblings(t).groupBy("node_id").agg(F.count("*").alias("n"), F.min("sibling_id").alias("first")).collect()))
    for few in (100_000, 0):
        monkeypatch.setattr(tree, "FEW", few)
        assert sorted(map(tuple, tree.sibling_counts(t).collect())) == want
    assert tree.sibling_counts(t.limit(0)).count() == 0


def test_a_large_family_makes_no_pairs(spark):
    """2,000,000 children of one parent would be 4e12 pairs."""
    t = spark.range(2_000_000).select(F.col("id").alias("node_id"), F.lit(-1).cast("long").alias("parent_id"))
    got = tree.sibling_counts(t).groupBy("n", "first").count().collect()
    assert sorted(map(tuple, got)) == [(1_999_999, 0, 1_999_999), (1_999_999, 1, 1)]
