from pyspark.sql import functions as F

from evidentia.plans import models, reasoning, reports
from evidentia.sources import sinks

TRIPLE = "paper_id int, triple_id int, subject string, predicate string, object string, completeness int"


def test_reasoning_steps(spark):
    words = {"T": ["theory"], "E": ["experiment"], "M": ["method"], "A": ["application"]}
    papers = spark.createDataFrame([(1, "A theory of sets. An experiment with theory."), (2, "The experiment ran."), (3, "Nothing here."), (4, None), (5, "")], "paper_id int, text string")
    triples = spark.createDataFrame([(1, 1, "A", "uses", "B", 0), (2, 2, "a", "USES", "b", 1), (2, 3, "a", "uses", "b", 3), (3, 4, "a", "uses", "b", 0), (3, 5, "", "x", "y", 0)], TRIPLE)
    terms = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "paper_id int, sentence_idx int, term string")
    sections = spark.createDataFrame([(7, "Theory of experiment"), (8, "of"), (9, None)], "section_id int, title string")
    got = reasoning.reason(papers, triples, papers.limit(0), terms, sections, 2, segment=lambda p: reasoning.segments(p, words))
    assert {(r["paper_id"], r["tag"]) for r in got.segments.collect()} == {(1, "T"), (2, "E")}
    assert [tuple(r) for r in got.relationships.collect()] == [("1", "T", "2", "E", "supports", "", ["a||uses||b"])]
    assert [(r["section_id"], r["paper_id"], r["score"], r["rank"]) for r in got.selections.orderBy("rank").collect()] == [(7, 1, 1.0, 1), (7, 2, 0.5, 2)]
    assert got.stats.first().asDict() == {"papers": 5, "total_segments": 2, "total_triples": 4, "fully_resolved_triples": 2, "total_info_units": 0, "relationships": 1, "sections": 3}
    empty = reasoning.reason(papers.limit(0), triples.limit(0), papers.limit(0), terms.limit(0), sections.limit(0))
    assert empty.relationships.isEmpty() and empty.selections.isEmpty() and empty.stats.first()["papers"] == 0


def test_relationships_from_answers(spark):
    triples = spark.createDataFrame([(1, 1, "A", "uses", "B", 0)], TRIPLE)
    rows = [("[1]T", "[2]E", None, None, ["A||uses||b", "x||y||z"]), ("odd", None, "extends", "why", None)]
    answers = spark.createDataFrame(rows, "from_ref string, to_ref string, relation string, explanation string, evidence array<string>")
    got = {tuple(map(str, r)) for r in reasoning.relationships(answers, triples).collect()}
    assert got == {("1", "T", "2", "E", "supports", "", "['a||uses||b']"), ("odd", "M", "", "M", "extends", "why", "[]")}


def test_a_triple_of_many_papers_gives_a_row_each(spark):
    triples = spark.range(300).select(F.col("id").cast("int").alias("paper_id"), F.col("id").cast("int").alias("triple_id"), F.lit("a").alias("subject"), F.lit("b").alias("predicate"), F.lit("c").alias("object"))
    parts = triples.select("paper_id", F.lit("T").alias("tag"), F.lit("").alias("text"))
    assert reasoning.shared_triples(parts, triples).count() == 299


def test_report_reranks_expands_and_counts_gaps(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"The method number {i} uses an encoder for retrieval. It reaches accuracy {i}.") for i in range(12)], "doc_id long, text string")
    index = reports.index(docs)
    loose = {"min_verified_facts": 2, "min_sentence_pool": 3}
    edges = spark.range(12).select(F.col("id").alias("src"), ((F.col("id") + 1) % 12).alias("dst"))
    number_7 = lambda q, t: F.when(F.contains(t, F.lit("number 7")), 1.0).otherwise(0.0)
    r = reports.full_report(index, "encoder retrieval", 1, thresholds=loose, scorer=number_7, edges=edges, more=5)
    assert r.checks["with_gaps"] == 0 and {x[0]: x[1] for x in r.stages} == {"rerank": None, "graph": None, "round": 0}
    assert {x["paper_id"] for x in r.evidence.collect()} == {6, 7, 8}
    all_gaps = lambda leaves: leaves.select("node_id", F.array(F.lit("more")).alias("gaps"))
    r = reports.full_report(index, "encoder retrieval", 4, thresholds=loose | {"max_gaps": 3}, critic=all_gaps)
    assert not r.passed and r.checks["with_gaps"] == 4 and "with_gaps" in r.checks["reason"]
    r = reports.full_report(index, "encoder retrieval", 2, thresholds=loose, scorer=lambda q, t: F.col("none"), edges=edges.drop("dst"))
    assert r.markdown and "none" in r.stages[0][1] and r.stages[1][0] == "graph" and r.stages[1][1]
    sinks.write_session(str(tmp_path), reports.session_record(r))
    used = {x["paper_id"] for x in r.evidence.collect()}
    assert {x["document_id"] for x in reports.query_session(index, str(tmp_path), r.session_id, "accuracy").collect()} == used
    again = reports.refine_session(index, str(tmp_path), r.session_id, "accuracy", target=5, thresholds=loose)
    assert again.query == "accuracy" and {x["paper_id"] for x in again.evidence.collect()} <= used


def test_prompts(spark):
    queries = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id int, query string")
    found = spark.createDataFrame([(1, i, f"d{i}", "x" * 600 if i < 12 else None) for i in range(1, 13)], "query_id int, rank int, document_id string, text string")
    got = {r["query_id"]: r["prompt"] for r in models.decision_prompt(queries, found).collect()}
    assert got[1].count("x" * 350) == 6 and "x" * 351 not in got[1] and "(nothing found)" in got[2] and got[1].startswith("Question: why?")
    got = {r["query_id"]: r["prompt"] for r in models.answer_prompt(queries, found).collect()}
    assert got[1].count("x" * 500) == 10 and "x" * 501 not in got[1] and "[10] d10: " in got[1]
    text = queries.select(models.critique_prompt(F.lit("T"), F.lit(None).cast("string"), F.lit("y" * 2000)).alias("p")).first()["p"]
    assert text.count("y" * 1000) == 1 and "y" * 1001 not in text and text.startswith("Section: T\nAbout: \nDraft: ")
