"""Similar sets by combinations of rare tokens, and their rows put in without a shuffle of pairs."""

import random

from pyspark.sql import functions as F

from evidentia.operators import dedup


def plain(sets, least):
    close = lambda x, y: x and y and len(x & y) / len(x | y) >= least
    return sorted((a, b) for a, x in sets.items() for b, y in sets.items() if a < b and close(x, y))


def test_pairs_equal_all_pairs_whatever_the_sizes(spark, monkeypatch):
    rng = random.Random(4)
    sets = {}
    for n in range(60):  # sets, and near and equal ones of each
        base = rng.sample(range(60), rng.choice([1, 2, 3, 5, 6, 9, 12, 14, 24, 25, 30, 40]))
        for m in range(4):
            sets[4 * n + m] = set(base[: len(base) - rng.randint(0, 2)]) | set(rng.sample(range(60), rng.randint(0, 2)))
    rows = spark.createDataFrame([(i, [f"t{x}" for x in s]) for i, s in sets.items()], "id int, tokens array<string>")
    for least, block, small in ((0.82, 1000, 24), (0.82, 2, 5), (0.5, 3, 24), (0.95, 1000, 1), (1.0, 1, 24)):
        monkeypatch.setattr(dedup, "BLOCK", block), monkeypatch.setattr(dedup, "SMALL", small)
        assert sorted((r["a"], r["b"]) for r in dedup.similar_pairs(rows, least).collect()) == plain(sets, least)


def test_equal_sets_shuffle_no_pairs(spark, monkeypatch):
    """300 equal titles are 44,850 pairs; what is compared is one set."""
    seen, similar = [], dedup.similar_sets
    monkeypatch.setattr(dedup, "similar_sets", lambda sets, least: seen.append(sets.count()) or similar(sets, least))
    rows = spark.range(300).select("id", F.array(F.lit("deep"), F.lit("graph"), F.lit("ranking")).alias("tokens"))
    assert dedup.similar_pairs(rows, 0.82).where("similarity = 1").count() == 44_850 and seen == [1]
