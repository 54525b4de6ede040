import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import attribution, dedup, graph, retrieval, selection, symbolic, tree
from evidentia.plans import models, reports
from evidentia.sources import readers, sinks
from evidentia.streaming import ingest


def choose(rows, target, mode):
    """One after another: within budgets first, then in turns."""
    budget = selection.budgets(target, mode)
    pools = {t: [r for r in rows if r[1] == t] for t in selection.TAGS}
    out = [r[0] for t in selection.TAGS for r in pools[t][: budget[t]]]
    pools = {t: pools[t][budget[t] :] for t in selection.TAGS}
    while len(out) < target and any(pools.values()):
        for t in selection.TAGS:
            if pools[t] and len(out) < target:
                out.append(pools[t].pop(0)[0])
    return out


def test_selection_matches_a_sequential_version(spark):
    rng = random.Random(5)
    for target, mode in ((0, "balanced"), (2, "diverse"), (5, "balanced"), (12, "rigorous"), (30, "balanced")):
        rows = [(i, rng.choice("TEMA" if target != 5 else "TEM"), i) for i in range(40)]
        got = selection.select_evidence(spark.createDataFrame(rows, "paper_id int, tag string, rank int"), target, mode).orderBy("position").collect()
        assert [r["paper_id"] for r in got] == choose(rows, target, mode)


def test_coverage_goldens(spark):
    def counts(pool, target):
        rows = [(f"{t}{i}", t, i) for t, n in pool.items() for i in range(n)]
        got = selection.select_evidence(spark.createDataFrame(rows, "paper_id string, tag string, rank int"), target)
        return {r["tag"]: r["count"] for r in got.groupBy("tag").count().collect()}

    assert selection.budgets(30) == {"T": 8, "E": 8, "M": 7, "A": 7}
    assert counts({"T": 3, "E": 4, "M": 12, "A": 9}, 30) == {"T": 3, "E": 4, "M": 12, "A": 9}
    one = selection.evidence_fingerprint(spark.createDataFrame([("demo1",)], "paper_id string")).first()
    assert one["fingerprint"] == "61ea51136a1eb39db39c889c9c53ebd21e5ce9e78721a6c2c40f8e16b782a879"


def greedy(titles, pairs, fixed):
    near = {}
    for a, b in pairs:
        near.setdefault(b, set()).add(a)
    into = {}
    for i in titles:
        hosts = [a for a in sorted(near.get(i, ())) if into[a] == a]
        into[i] = i if i in fixed or not hosts else hosts[0]
    return into


def test_first_come_matches_a_sequential_version(spark):
    rng = random.Random(7)
    for _ in range(4):
        n = 25
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(40)})
        fixed = set(rng.sample(range(n), 5))
        rows = spark.createDataFrame([(i, i in fixed) for i in range(n)], "ord long, f boolean")
        got = dedup.first_come(rows, spark.createDataFrame(pairs, "a long, b long"), F.col("f"))
        assert {r["ord"]: r["into"] for r in got.collect()} == greedy(range(n), pairs, fixed)


def test_deduplicate(spark):
    rows = [
        (0, "Deep Learning for Graph Retrieval", "10.1/x", None, ["u1"], 3, 0.0), (1, "Deep learning for graph retrieval", "10.1/X ", "p", ["u2"], 9, 1.0),
        (2, "Deep Learning of Graph Retrieval", None, None, None, 1, 0.0), (3, "Something else entirely new", None, None, None, 1, 0.0), (4, "", None, None, None, 1, 0.0),
    ]
    df = spark.createDataFrame(rows, "ord long, title string, doi string, pdf_url string, pdf_alternatives array<string>, citation_count int, relevance_score double")
    got = {r["ord"]: r for r in dedup.deduplicate(df).collect()}
    assert set(got) == {0, 3, 4}
    assert (got[0]["pdf_url"], got[0]["pdf_alternatives"], got[0]["citation_count"], got[0]["relevance_score"]) == ("p", ["u1", "u2"], 9, 1.0)


def test_similar_pairs_match_all_pairs(spark):
    rng = random.Random(9)
    sets = {i: sorted(rng.sample("abcdefgh", rng.randint(0, 6))) for i in range(40)}
    got = {(r["a"], r["b"]) for r in dedup.similar_pairs(spark.createDataFrame(list(sets.items()), "id int, tokens array<string>"), 0.6).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.6}
    assert got == want


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)], "src long, dst long")
    seed = spark.createDataFrame([(1,)], "node long")
    assert {(r["node"], r["hop"]) for r in graph.k_hop(e, seed, 3).collect()} == {(2, 1), (3, 2), (1, 3), (4, 3)}
    assert {r["node"] for r in graph.k_hop(e, seed, 1, forward=True).collect()} == {3, 5}
    assert [r["node"] for r in graph.shortest_path(e, 5, 4).orderBy("hop").collect()] == [5, 1, 2, 3, 4]
    assert graph.shortest_path(e, 4, 5).isEmpty() and [r["node"] for r in graph.shortest_path(e, 1, 1).collect()] == [1]
    s = graph.graph_stats(e).first()
    assert (s["nodes"], s["edges"], s["density"]) == (5, 5, 0.25)
    assert graph.graph_stats(e.limit(0)).first()["density"] == 0.0
    assert {r["node"]: r["level"] for r in graph.expand(e, seed, 2, 10).collect()} == {2: 1, 3: 2}
    made = graph.build_edges(spark.createDataFrame([("a", ["b", "b"], None)], "doc_id string, bibliography array<string>, references array<string>"))
    assert [tuple(r) for r in made.collect()] == [("a", "b", "cites")]


def test_tree(spark):
    t = tree.build_outline(spark, "Root", [{"title": "A", "description": "a", "percent": 60}, {"title": "B", "description": "b", "percent": 40}])
    t = tree.add_child(t, "n1", "n3", "A1")
    deep = tree.add_depth(t).withColumn("draft", F.concat(F.lit("text "), "title")).withColumn("confidence", F.lit(0.5)).withColumn("gaps", F.array().cast("array<string>")).withColumn("is_complete", F.lit(True))
    drafts = tree.roll_up(deep)
    assert drafts.where("node_id = 'n0'").first()["draft"] == "## Root\n\n\n\n### A\n\n## A\n\na\n\n### A1\n\ntext A1\n\n### B\n\ntext B"
    assert tree.tree_stats(deep).first().asDict() == {"total_nodes": 4, "max_depth": 2, "leaves": 2, "complete": 4, "with_gaps": 0, "avg_confidence": 0.5}
    facts = spark.createDataFrame([(True,), (False,)], "verified boolean")
    report = tree.compile_report(deep, drafts, facts).first()["report"]
    assert "**Sections:** 2" in report and "1. [A](#section-1)" in report and "   1.1. [A1](#section-1-1)" in report
    grown = tree.expand_gaps(t, lambda leaves: leaves.select("node_id", F.when(F.col("depth") == 1, F.array(F.lit("x"), F.lit("y"), F.lit("z"))).otherwise(F.array().cast("array<string>")).alias("gaps")), 3)
    assert {r["node_id"] for r in grown.collect()} == {"n0", "n1", "n2", "n3", "n2.0", "n2.1"}


def test_symbolic(spark):
    tags = lambda s: spark.createDataFrame([(1, i, t) for i, t in enumerate(s.split())], "seq_id int, pos int, tag string")
    for s, want in (("O B I I O B I O", {(1, 4), (5, 7)}), ("B I O O", {(0, 2)}), ("O O O", set())):
        assert {(r["st"], r["ed"]) for r in symbolic.bio_spans(tags(s)).collect()} == want
    docs = spark.createDataFrame([(1, "Methods\nwe do it here\n\nand there too.\nEmpty\n1. Results\nit works well.")], "doc_id int, text string")
    got = [(r["heading"], r["body"]) for r in symbolic.paragraphs(symbolic.lines(docs)).orderBy("part").collect()]
    assert got == [("Methods", "we do it here\nand there too."), ("1. Results", "it works well.")]
    triples = spark.createDataFrame([("p", 1, "A", "uses", "B", 0), ("p", 2, "A", "uses", "zzz", 3), ("p", 3, "q", "r", "s", 1)], "paper_id string, triple_id int, subject string, predicate string, object string, completeness int")
    terms = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("x", 5, "uses")], "paper_id string, sentence_idx int, term string")
    assert {r["triple_id"]: r["completeness"] for r in symbolic.resolve_triples(triples, terms).collect()} == {1: 2, 2: 3, 3: 0}
    found = symbolic.nested_sources(spark.createDataFrame([(1, '{"a": [{"b": {"from sentence": "s1"}}], "from sentence": "s0"}'), (2, "broken")], "paper_id int, json string"))
    assert {(r["path"], r["sentence"]) for r in found.collect()} == {("a/b", "s1"), ("", "s0")}


def test_retrieval_and_attribution(spark):
    chunks = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "y"), (2, [0.0, 1.0], "x")], "chunk_ord int, embedding array<double>, section string")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, q_vec array<double>")
    scored = retrieval.score_all(q, chunks)
    assert [r["chunk_ord"] for r in retrieval.top_k(scored, 2).orderBy("rank").collect()] == [0, 1]
    assert [r["chunk_ord"] for r in retrieval.over_fetch(scored, 1, F.col("section") == "y").collect()] == [1]
    assert retrieval.over_fetch(scored, 1, F.col("section") == "z").isEmpty()
    docs = spark.createDataFrame([(1, "Cats are grey [1]. Dogs chase cats. Hi.")], "doc_id int, text string")
    passages = spark.createDataFrame([(1, 5, "dogs chase cats all day")], "doc_id int, passage_id int, text string")
    got = {r["sentence_ord"]: (r["citation_ids"], r["verified"], r["confidence"]) for r in attribution.attribute(docs, passages).collect()}
    assert got == {0: (["1"], True, None), 1: (["5"], False, 0.8)}


def test_records_and_reports(spark):
    raw = spark.createDataFrame([('{"paperId": "p", "title": "T", "abstract": null, "year": 2020, "authors": [{"name": "A"}, "B"], "externalIds": {"DOI": "10.1/x", "CorpusId": 5}, "references": [{"citedPaper": {"paperId": "r", "title": "R", "year": 1}}, {"paperId": "s"}]}',), ("{}",)], "json string")
    got = readers.paper_records(raw).orderBy(F.desc("paper_id")).collect()
    assert (got[0]["paper_id"], got[0]["authors"], got[0]["doi"], got[0]["corpus_id"], [r["paper_id"] for r in got[0]["references"]], got[0]["abstract"]) == ("p", ["A", "B"], "10.1/x", "5", ["r", "s"], "")
    assert (got[1]["paper_id"], got[1]["authors"], got[1]["year"]) == ("", [], 0)
    body = "b" * 40
    made = readers.report_chunks(spark.createDataFrame([("q", f"# One\n{body}\n## Two\nshort\n### Three\n{body} [l](https://u.v)")], "query string, markdown string")).collect()
    assert [(r["section_header"], r["title"]) for r in made] == [("# One", "One"), ("### Three", "Three")] and made[0]["sources"] == ["https://u.v"]


def test_files_sessions_and_themes(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"good \xff text")
    (tmp_path / "in" / "sub" / "a.md").write_text("other")
    (tmp_path / "in" / "b.csv").write_text("no")
    (tmp_path / "in" / "c.txt").write_text("   ")
    got = {r["doc_id"]: r["text"] for r in readers.read_documents(spark, str(tmp_path / "in")).collect()}
    assert len(got) == 2 and got["a"] == "good  text"
    with pytest.raises(Exception):
        readers.read_documents(spark, str(tmp_path / "none")).collect()
    sinks.write_session(str(tmp_path / "s"), {"session_id": "x_1", "query": "q"})
    assert sinks.read_session(spark, str(tmp_path / "s"), "x_1").first()["query"] == "q"
    with pytest.raises(KeyError):
        sinks.read_session(spark, str(tmp_path / "s"), "none")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id int")
    status = {r["doc_id"]: (r["status"], r["newly_used"]) for r in sinks.theme_status(ids(1, 2, 3), ids(1, 2), ids(2)).collect()}
    assert status == {1: ("used", True), 2: ("used", False), 3: ("remaining", False)}


def test_report_loop(spark):
    docs = spark.createDataFrame([(i, f"The method number {i} uses an encoder for retrieval. It reaches accuracy {i}. The application is a system.") for i in range(12)], "doc_id long, text string")
    index = reports.index(docs)
    assert reports.status(index) == {"chunks": 12, "documents": 12}
    assert reports.search(index, "encoder retrieval method", 3).count() == 3
    loose = {"min_verified_facts": 2, "min_sentence_pool": 3}
    r = reports.full_report(index, "encoder retrieval", 4, thresholds=loose)
    assert r.passed and r.markdown.startswith("## encoder retrieval") and len(reports.session_record(r)["evidence_papers"]) == 4
    r = reports.full_report(index, "encoder retrieval", 2, thresholds={"min_verified_facts": 20, "min_sentence_pool": 3}, rounds=1, more=3)
    assert not r.passed and r.rounds == 2 and len(reports.session_record(r)["evidence_papers"]) == 5 and r.markdown
    assert reports.verify_one(index, "reaches accuracy 3", 3)["verified"]


def test_prompt(spark):
    m = spark.createDataFrame([(1, 0, "user", " hi "), (1, 1, "system", "be kind"), (1, 2, "assistant", "hello"), (1, 3, "tool", ""), (1, 4, None, "x")], "conv_id int, turn int, role string, text string")
    assert models.prompt(m).first()["prompt"] == "[System]\nbe kind\n\n[User]\nhi\n[Assistant]\nhello\n[User]\nx"


def test_streamed_ingestion(spark, tmp_path):
    src, out = str(tmp_path / "docs"), str(tmp_path / "index")
    for i in range(2):
        spark.createDataFrame([(i, "some text. " * 200, "en", "s", 2200)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("append").parquet(src)
        ingest.ingest(ingest.stream_documents(spark, src), out, str(tmp_path / "cp")).awaitTermination()
    streamed = spark.read.parquet(out)
    assert streamed.select("document_id").distinct().count() == 2
    assert streamed.count() == retrieval.chunks(spark.read.parquet(src)).count()
