"""Exact search by blocks: the rows that scoring every pair gives, for any number of queries, without texts in what is ranked."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from evidentia.functions.vectors import dot
from evidentia.operators import retrieval
from evidentia.plans import leaves, reports

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("queries,rows", [(4096, 16384), (5, 7)])
def test_blocks_find_what_all_pairs_give(spark, monkeypatch, queries, rows):
    monkeypatch.setattr(retrieval, "QUERIES", queries), monkeypatch.setattr(retrieval, "ROWS", rows)
    rng = random.Random(5)
    vectors = [[rng.choice([0.0, 0.5, -1.0, 0.25, 1e-7]) for _ in range(3)] for _ in range(60)]
    vectors += [[NAN, 1.0, 0.0], [INF, 0.0, 1.0], [-INF, 1.0, 1.0], None, [1.0, None, 2.0], [1.0], [], [1.0, 2.0, 3.0, 4.0]] * 2
    r = spark.createDataFrame(list(enumerate(vectors)), "id int, embedding array<float>")
    q = spark.createDataFrame([*((i, v) for i, v in enumerate(vectors) if i % 3 == 0), (200, vectors[0]), (201, None), (202, [NAN] * 3), (203, [1.0])], "query_id int, q_vec array<float>")
    every = retrieval.score_all(q, r, measure=lambda a, b: F.round(dot(a, b), 6))
    for k, itself in ((1, True), (4, False), (200, False)):
        want = retrieval.top_k(every if itself else every.where("query_id <> id"), k, tie="id").select("query_id", "id", "score", "rank")
        assert sorted(map(repr, retrieval.nearest(q, r, k, "id", itself=itself).collect())) == sorted(map(repr, want.collect()))
    assert retrieval.nearest(q, r.limit(0), 3, "id").count() == retrieval.nearest(q.limit(0), r, 3, "id").count() == 0


def test_drafts_rank_chunks_without_their_texts(spark, monkeypatch):
    ranked, top_k = [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda scored, *a, **b: ranked.append(scored.columns) or top_k(scored, *a, **b))
    docs = spark.createDataFrame([(i % 7, f"The method number {i} uses an encoder for retrieval of texts.") for i in range(14)], "doc_id long, text string")
    nodes = spark.createDataFrame([("a", "encoder", None), ("b", "method number", None)], "node_id string, title string, keywords array<string>")
    got = leaves.process_leaves(nodes, reports.index(docs), k=3)
    assert ranked and not any("text" in columns for columns in ranked)
    assert got.nodes.where("n_facts > 0").count() == 2 and got.evidence.groupBy("node_id").count().collect()[0]["count"] == 3
    assert got.evidence.where(~F.contains("text", F.lit("encoder"))).isEmpty()


def test_leaf_facts_of_more_leaves_than_were_allowed(spark, tmp_path):
    spark.createDataFrame([(i, "encoder retrieval" if i % 2 else "accuracy") for i in range(10_001)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, f"The encoder number {i} is used for retrieval. It reaches an accuracy of {i} points.") for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["leaf_facts"](spark, str(tmp_path))
    assert [tuple(r) for r in got.groupBy("score").agg(F.countDistinct("node_id").alias("n"), F.count("*").alias("rows")).orderBy("n").collect()] == [(1.0, 10_001, 30_003)]


@pytest.fixture(scope="module")
def many_queries(spark, tmp_path_factory):
    """Vectors of which more than 10,000 are queries, the folder that has them."""
    path = str(tmp_path_factory.mktemp("vectors"))
    rng = np.random.default_rng(3)
    vectors = rng.integers(-8, 9, (10_001, 3)) / 8
    rows = [(50 * i, v.tolist(), int(i % 5)) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path, vectors


def first(vectors, i, k):
    """Places of the k nearest to i by brute force, and their scores; exact, as components are eighths."""
    scores = np.round(vectors @ vectors[i], 6)
    order = np.lexsort((np.arange(len(vectors)), -scores))
    order = order[order != i][:k]
    return order, scores[order]


def test_dense_topk_of_many_queries(spark, many_queries):
    path, vectors = many_queries
    got = __spark_entry__.queries()["dense_topk"](spark, path).where("query_id IN (0, 50, 250000, 500000)").collect()
    want = {(50 * i, 50 * int(j), float(s), n + 1) for i in (0, 1, 5000, 10_000) for n, (j, s) in enumerate(zip(*first(vectors, i, 10)))}
    assert {(r["query_id"], r["vec_id"], round(r["score"], 5), r["rank"]) for r in got} == {(q, v, round(s, 5), n) for q, v, s, n in want} and len(got) == 40


def test_candidates_of_many_queries(spark, many_queries):
    path, vectors = many_queries
    got = {(r["query_id"], r["label"]): (r["vec_id"], r["rank"]) for r in __spark_entry__.queries()["candidate_docs"](spark, path).where("query_id IN (0, 50, 250000, 500000)").collect()}
    want = {}
    for i in (0, 1, 5000, 10_000):
        for n, j in enumerate(first(vectors, i, 50)[0]):
            want.setdefault((50 * i, int(j) % 5), (50 * int(j), n + 1))
    assert got == want


def test_topk_section_filter_of_many_queries(spark, many_queries):
    path, vectors = many_queries
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in __spark_entry__.queries()["topk_section_filter"](spark, path).where("query_id IN (0, 50, 250000, 500000)").collect()}
    want = {(50 * i, n + 1): 50 * int(j) for i in (0, 1, 5000, 10_000) for n, j in enumerate([j for j in first(vectors, i, 20)[0] if j % 5 < 3][:10])}
    assert got == want
