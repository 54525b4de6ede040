import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions.scores import local_support
from evidentia.operators import attribution, postings, retrieval


def texts(seed, n, longest, words):
    r = random.Random(seed)
    made = [" ".join(r.choice(words) for _ in range(r.randint(0, longest))) for _ in range(n)]
    return [t.upper() if i % 7 == 0 else t for i, t in enumerate(made)]


WORDS = ["the", "of", "cell", "cells", "gene", "12", "3.5", "net", "network", "a", "é", "x-ray", "deep", "in", "model"] + [f"w{i}" for i in range(60)]


def plain(facts, sources, k, fill, digits=6):
    """All pairs, scored one by one."""
    support = local_support(F.coalesce("f.text", F.lit("")), F.coalesce("s.text", F.lit("")))
    every = facts.alias("f").crossJoin(sources.alias("s")).select("item", "source", F.round(support, digits).alias("score"))
    return retrieval.top_k(every.where("score > 0") if not fill else every, k, "item", "source")


@pytest.mark.parametrize("fill", [True, False])
def test_supporting_equals_all_pairs(spark, fill):
    facts = texts(1, 40, 6, WORDS) + ["", None, "ell", "cell", "et the", "the of", "12", "the", "zzz", "net", "f the c"]
    sources = texts(2, 60, 40, WORDS) + ["", None, "cells", "network"]
    f = spark.createDataFrame(list(enumerate(facts)), "item int, text string")
    s = spark.createDataFrame(list(enumerate(sources)), "source int, text string")
    got, want = postings.supporting(f, s, 3, fill), plain(f, s, 3, fill)
    rows = lambda df: {(r["item"], r["source"], round(r["score"], 6), r["rank"]) for r in df.collect()}
    assert rows(got) == rows(want)
    assert got.count() == want.count()
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "item int, text string")
    some = spark.createDataFrame([(1, "a cell"), (2, "")], "item int, text string")
    empty = spark.createDataFrame([], "source int, text string")
    assert postings.supporting(none, some.withColumnRenamed("item", "source"), 3).isEmpty()
    assert postings.supporting(some, empty, 3).isEmpty()
    assert postings.holding(spark.createDataFrame([], "item int, terms array<string>"), empty, 3).isEmpty()


def test_holding_equals_all_pairs(spark):
    terms = [t.lower().split() for t in texts(3, 20, 5, ["cell", "gene", "net", "odel", "w1", "w12", "ray", "12"])]
    terms = [sorted(set(t)) for t in terms] + [["zzz"], [], None]
    sources = texts(4, 50, 12, WORDS) + ["", None]
    items = spark.createDataFrame(list(enumerate(terms)), "item int, terms array<string>")
    got = postings.holding(items, spark.createDataFrame(list(enumerate(sources)), "source int, text string"), 4)
    want = set()
    for i, ts in enumerate(terms):
        low = [(t or "").lower() for t in sources]
        share = [(-sum(t in x for t in ts) / len(ts) if ts else 0.0, j) for j, x in enumerate(low)]
        want |= {(i, j, round(-s, 9), n) for n, (s, j) in enumerate(sorted(share)[:4], 1)}
    assert {(r["item"], r["source"], round(r["score"], 9), r["rank"]) for r in got.collect()} == want


def test_attribution_equals_all_pairs(spark):
    docs = [(d, ". ".join(t.capitalize() for t in texts(10 + d, 8, 7, WORDS) if len(t) > 4) + ".") for d in range(5)] + [(None, "Deep cell models."), (9, None)]
    given = [(d, f"p{j % 9}", t) for d in range(5) for j, t in enumerate(texts(20 + d, 10, 30, WORDS))] + [(0, "p3", None), (None, "p", "deep cell models."), (7, "p", "x")]
    given += given[:3]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    p = spark.createDataFrame(given, "doc_id int, passage_id string, text string")
    got = {(r["doc_id"], r["sentence_ord"]): (r["citation_ids"], r["confidence"]) for r in attribution.attribute(d, p).where("NOT verified").collect()}
    open_ones = attribution.attribute(d).where("NOT verified").alias("s")
    pairs = open_ones.join(p.alias("p"), F.expr("s.doc_id = p.doc_id")).where("p.text IS NOT NULL").select("s.doc_id", "sentence_ord", "passage_id", local_support("s.text", "p.text").alias("score"))
    best = pairs.where("score >= 0.5").groupBy("doc_id", "sentence_ord").agg(F.min_by("passage_id", F.struct(-F.col("score"), "passage_id")).alias("p"))
    want = {(r["doc_id"], r["sentence_ord"]): (["" + r["p"]], 0.8) for r in best.collect()}
    assert len(want) > 5
    assert got == {(r["doc_id"], r["sentence_ord"]): want.get((r["doc_id"], r["sentence_ord"]), ([], 0.0)) for r in open_ones.collect()}
