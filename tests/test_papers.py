import json

from pyspark.sql import functions as F

from evidentia.functions.text import cache_key
from evidentia.operators import graph, symbolic, tree
from evidentia.sources import papers, readers


def test_api_bodies_without_parts(spark):
    bodies = spark.createDataFrame([(1, None), (2, ""), (3, "{broken"), (4, "{}")], "page int, body string")
    assert papers.openalex(bodies).count() == papers.crossref(bodies).count() == 0
    assert papers.arxiv(bodies).count() == 0
    bare = spark.createDataFrame([(json.dumps({"results": [{}, {"open_access": {"oa_url": "", "pdf_url": "p"}, "authorships": [{}]}]}),)], "body string")
    rows = papers.openalex(bare).collect()
    assert [(r.title, r.authors, r.year, r.pdf_url, r.citation_count, r.is_oa) for r in rows] == [("", [], None, "", 0, False), ("", [""], None, "p", 0, False)]
    bare = spark.createDataFrame([(json.dumps({"message": {"items": [{}, {"title": []}, {"link": [{"URL": "x"}]}]}}),)], "body string")
    assert [(r.title, r.authors, r.year, r.pdf_url) for r in papers.crossref(bare).collect()] == [("", [], None, "")] * 3
    assert papers.crossref(bare, most=2).count() == 2


def test_arxiv_feed(spark):
    feed = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>q</title>
    <entry><id>http://arxiv.org/abs/1v2</id><title type="text">
 One </title><author><name>A</name></author><author><name>B</name></author><arxiv:doi>d</arxiv:doi></entry>
    <entry><published>soon</published></entry></feed>"""
    one, two = papers.arxiv(spark.createDataFrame([(feed,)], "body string")).collect()
    assert (one.title, one.authors, one.year, one.url, one.pdf_url) == ("One", ["A", "B"], None, "http://arxiv.org/abs/1v2", "https://arxiv.org/pdf/1v2.pdf")
    assert (two.title, two.authors, two.year, two.pdf_url) == ("", [], None, "")


def test_links_of_papers(spark):
    raw = {"paperId": "p", "citations": [{"citingPaper": {"paperId": "a", "year": 1}}, {"citingPaper": {}}, {"paperId": "b", "title": "t"}]}
    rows = papers.paper_links(readers.paper_records(spark.createDataFrame([(json.dumps(raw),), ("{}",)], "json string")), "citations").collect()
    assert [tuple(r) for r in rows] == [("p", 0, "a", "", 1), ("p", 1, "b", "t", 0)]


def test_recommendations_from_the_cache(spark):
    many = json.dumps({"papers": [{"paperId": f"r{i}"} for i in range(30)] + [None, {}]})
    stored = spark.createDataFrame([("p:20", many), ("p:2", many), ("q:3", "{broken"), ("s:-1", many)], "query string, body string")
    cache = stored.select(cache_key(F.lit("related"), "query").alias("key"), "body")
    asked = spark.createDataFrame([("p", None), ("p", 20), ("p", 2), ("q", 3), ("r", 1), ("s", -1), (None, 1)], "paper_id string, `limit` int")
    rows = papers.recommendations(asked, cache).collect()
    assert sorted((r.paper_id, r.nth, r.linked_id, r.title, r.year) for r in rows) == sorted(
        [("p", i, f"r{i}", "", 0) for i in range(20)] + [("p", i, f"r{i}", "", 0) for i in range(2)])
    assert papers.recommendations(asked, cache, most=1).count() == 2
    assert papers.recommendations(asked.limit(0), cache).isEmpty()


def test_search_and_expand(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 5), (3, 1), (6, 1), (9, 2), (1, 2)], "src int, dst int")
    found = spark.createDataFrame([(1, 1), (9, 2), (1, 3), (None, 0)], "node int, rank int")
    rows = graph.search_and_expand(edges, found, 2, 1, per_paper=2).collect()
    assert {tuple(r) for r in rows} == {(1, 0, 1, 0), (9, 0, 2, 0), (2, 1, 1, 1), (3, 1, 1, 1), (5, 1, 1, 2), (6, 2, 1, 1)}
    assert graph.search_and_expand(edges, found.where("node > 100")).isEmpty()


def test_triples_in_annotations(spark):
    nested = {"C": {"M": {"uses": {"BERT": {"from sentence": " We use BERT. "}, "CNN": ["a", {"on": "x"}], "from sentence": "Both."}}}}
    ask = [("M", "uses", "BERT"), ("uses", "CNN", "a"), ("CNN", "on", "x"), ("C", "uses", "M"), (None, None, None)]
    rows = spark.createDataFrame([(i, json.dumps(nested), *t) for i, t in enumerate(ask)] + [(9, "{", "a", "b", "c"), (10, None, "a", "b", "c")],
                                 "paper_id int, json string, subject string, predicate string, object string")
    found = {}
    for r in symbolic.triple_sources(rows).collect():
        found.setdefault(r.paper_id, set()).add(r.sentence)
    assert found == {0: {"We use BERT.", "Both."}, 1: {"Both."}, 2: {"Both."}}


def test_sections_records_and_citations(spark):
    outline = tree.build_outline(spark, "t", [{"title": "a", "percent": 40}, {"title": "b", "percent": 60}])
    gaps = spark.createDataFrame([(0, "g", "d", ["k"]), (1, None, None, None)], "ord int, title string, description string, keywords array<string>")
    grown = tree.append_sections(outline, gaps)
    assert [tuple(r) for r in grown.where("parent_id = 'n0'").orderBy("ord").select("node_id", "ord", "title").collect()] == [
        ("n1", 0, "a"), ("n2", 1, "b"), ("n0.s0", 2, "g"), ("n0.s1", 3, "Missing Section"),
    ]
    facts = spark.createDataFrame([("n1", "d1"), ("n1", "d1"), ("n1", ""), ("n2", None)], "node_id string, source_doc string")
    assert [tuple(r) for r in tree.node_citations(facts).collect()] == [("n1", "[d1]")]
    root = tree.node_records(tree.add_depth(grown), facts).where("id = 'n0'").first()
    assert (root.children_count, root.facts_count, root.is_leaf, root.value, root.parent) == (4, 0, False, 1.0, None)
    assert tree.append_sections(outline.where("node_id = 'n0'"), gaps).count() == 3
