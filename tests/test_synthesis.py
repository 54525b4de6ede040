"""Reports from given evidence, their statistics and files, clusters and model support."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.functions import scores
from evidentia.operators import dedup, selection
from evidentia.plans import reports, synthesis


@pytest.fixture(scope="module")
def index(spark):
    about = ["graph ranking", "dense retrieval", "citation graphs"]
    docs = [(i, f"The study of {about[i % 3]} uses an encoder. It reaches an accuracy of {i} points in {about[i % 3]}.\nThe analysis of {about[i % 3]} shows gains.") for i in range(12)]
    return reports.index(spark.createDataFrame(docs, "doc_id long, text string"))


def test_synthesis_is_restricted_to_its_evidence(spark, index, tmp_path):
    ids = spark.createDataFrame([(0,), (1,), (3,), (4,), (99,)], "document_id long")
    sections = [{"title": "Ranking", "keywords": ["graph", "ranking"]}, {"title": "Dense retrieval"}, {"title": "Zebras"}]
    got = synthesis.synthesize(index, "How to rank?", ids, sections)
    assert {r["source_doc"] for r in got.facts.collect()} <= {0, 1, 3, 4} and got.stats["total_sections"] == 3 and got.stats["with_gaps"] == 1
    facts = got.facts.count()
    assert got.stats["verification_rate"] == f"{facts}/{facts} = 100%" and got.stats["verified_facts"] == facts > 0
    assert "## Ranking" in got.markdown and "[No relevant facts found for this section.]" in got.markdown and got.markdown.startswith("# Research Synthesis")
    assert set(got.tree) == {"sections", "leaves", "max_depth", "with_gaps", "avg_confidence"} and got.tree["max_depth"] == 1
    path = synthesis.write_result(got, str(tmp_path / "a" / "r.json"))
    assert json.load(open(path))["stats"] == got.stats and open(synthesis.write_result(got, str(tmp_path / "r.md"))).read() == got.markdown
    with pytest.raises(LookupError):
        synthesis.synthesize(index, "q", ids.where("document_id = 99"))


def test_default_outline_and_critic(spark, index):
    got = synthesis.synthesize(index, "graphs", most_sections=3, k=4)
    titles = [r["title"] for r in got.outline.where("depth = 1").orderBy("ord").collect()]
    assert len(titles) == 3 and all(" " in t for t in titles)
    critic = lambda leaves: leaves.select("node_id", F.when(F.col("depth") == 1, F.array(F.lit("accuracy points"), F.lit("encoder"))).otherwise(F.array().cast("array<string>")).alias("gaps"))
    grown = synthesis.synthesize(index, "graphs", sections=[{"title": "Graph ranking"}], critic=critic)
    assert grown.stats["total_leaves"] == 2 and grown.stats["max_depth"] == 2 and "### accuracy points" in grown.markdown
    repeated = grown.facts.groupBy(F.substring("text", 1, 100)).agg(F.count("*").alias("n"), F.min("confidence").alias("c")).where("n > 1").collect()
    assert all(r["c"] < 1 for r in repeated)


def test_sections_are_kept_one_by_one(index, tmp_path, monkeypatch):
    path = str(tmp_path / "sections.json")
    made = []
    real = synthesis.synthesize

    def once(index, query, **options):
        made.append(query)
        if query == "bad":
            raise LookupError("nothing")
        if query == "stop" and made.count("stop") == 1:
            raise KeyboardInterrupt
        return real(index, query, **options)

    monkeypatch.setattr(synthesis, "synthesize", once)
    short = {"sections": [{"title": "Encoder"}], "k": 2}
    with pytest.raises(KeyboardInterrupt):
        synthesis.write_sections(index, ["one", "bad", "stop"], path, **short)
    assert [x["query"] for x in json.load(open(path))] == ["one", "bad"]
    held = synthesis.write_sections(index, ["one", "bad", "stop"], path, **short)
    assert [(x["query"], "text" in x) for x in held] == [("one", True), ("bad", False), ("stop", True)] and made.count("one") == 1


def test_statistics_clusters_and_support(spark):
    facts = spark.createDataFrame([("a", True, 0.9), ("a", False, 0.2), ("a", None, None), ("b", True, 1.0)], "node string, verified boolean, confidence double")
    assert [tuple(r) for r in synthesis.report_statistics(facts).collect()] == [(4, 2, "2/4 = 50%", 0.7)]
    assert {r["node"]: r["verification_rate"] for r in synthesis.report_statistics(facts, ["node"]).collect()} == {"a": "1/3 = 33%", "b": "1/1 = 100%"}
    assert synthesis.report_statistics(facts.limit(0)).first()["verification_rate"] == "0/0 = 0%"
    chosen = selection.select_evidence(spark.createDataFrame([(i, "TEM"[i % 3], i) for i in range(9)], "paper_id int, tag string, rank int"), 6)
    rows = selection.clusters(chosen, 6).collect()
    assert {(r["cluster_id"], r["n"], r["note"], r["budget"]) for r in rows} == {("cluster_T", 3, "Selected 3 for tag T", 2), ("cluster_E", 2, "Selected 2 for tag E", 2), ("cluster_M", 1, "Selected 1 for tag M", 1)}
    assert sorted((r["cluster_id"], r["nth"]) for r in rows) == [("cluster_E", 1), ("cluster_E", 2), ("cluster_M", 1), ("cluster_T", 1), ("cluster_T", 2), ("cluster_T", 3)]
    said = spark.createDataFrame([(0.8, True), (0.8, False), (None, True), (0.5, None)], "c double, s boolean")
    assert [round(r[0], 6) for r in said.select(scores.model_support("c", "s")).collect()] == [0.8, 0.24, 0.0, 0.15]


def test_search_statistics(spark):
    papers = spark.createDataFrame([("a", True), ("", None), (None, False), ("b", True)], "pdf_url string, is_oa boolean")
    assert dedup.search_statistics(papers, papers.limit(3)).first().asDict() == {"raw": 4, "unique_papers": 3, "with_pdf": 1, "open_access": 1}
    assert dedup.search_statistics(papers.limit(0), papers.limit(0)).first().asDict() == {"raw": 0, "unique_papers": 0, "with_pdf": 0, "open_access": 0}
