"""Triples, key phrases, leaves and verification against plain versions."""

import random
import re

from pyspark.sql import functions as F

from evidentia.functions import scores
from evidentia.functions.text import STOP_WORDS
from evidentia.operators import attribution, extraction
from evidentia.plans import leaves, models, reasoning, reports


def kinds_to_triples(kinds):
    """The spans as a regular expression finds them."""
    return [tuple(m.span(g) for g in (1, 2, 3)) for m in re.finditer("(N+)D*(V+)D*(N+)", "".join(kinds))]


def test_the_chunker_finds_what_a_pattern_finds(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("NNNVVDDB") for _ in range(rng.randint(0, 25))]) for i in range(400)] + [(400, None)]
    got = spark.createDataFrame(rows, "id int, kinds array<string>").select("id", extraction.triple_spans(F.col("kinds")).alias("t")).collect()
    for r in got:
        want = kinds_to_triples(rows[r["id"]][1] or [])
        assert [((t["s0"], t["s1"]), (t["v0"], t["v1"]), (t["o0"], t["o1"])) for t in r["t"] or []] == want


def test_triples_of_texts(spark):
    text = "Results\nOur new model uses the transformer encoder. It improved accuracy by 5%, and BERT is applied to\nquestion answering. Nothing here.\nRelated Work\nOthers employ large-scale graphs"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 30_000 + "uses things", "x")], "doc_id int, text string, heading string")
    got = [(r["paper_id"], r["sentence_idx"], r["subject"][-20:], r["predicate"], r["object"], r["info_unit"], r["completeness"]) for r in extraction.extract_triples(docs).collect()]
    assert sorted(got) == [
        (1, 0, "Our new model", "uses", "transformer encoder", "Results", 3),
        (1, 1, "BERT", "applied", "question answering", "Results", 3),
        (1, 3, "Others", "employ", "large-scale graphs", "Positioning", 3),
        (4, 0, ("word " * 30_000).strip()[-20:], "uses", "things", "Contribution", 3),
    ]
    assert extraction.extract_triples(docs.limit(0)).count() == 0


def plain_phrases(rows, most=5, longest=4):
    found, freq, degree = {}, {}, {}
    for doc, idx, text in rows:
        words = [("|" if re.fullmatch(r"[,;:()\[\].!?]", w) or w.lower() in STOP_WORDS else w.lower()) for w in re.findall(r"[^\W_][\w'-]*|[,;:()\[\].!?]", text or "")]
        runs = [r.split() for r in " ".join(words).split("|") if r.strip()]
        found[doc, idx] = [(n, r) for n, r in enumerate(runs) if len(r) <= longest]
        for _, r in found[doc, idx]:
            for w in r:
                freq[doc, w] = freq.get((doc, w), 0) + 1
                degree[doc, w] = degree.get((doc, w), 0) + len(r)
    out = {}
    for (doc, idx), phrases in found.items():
        best = {}
        for n, r in phrases:
            best.setdefault(" ".join(r), (-round(sum(degree[doc, w] / freq[doc, w] for w in r), 9), n))
        out[doc, idx] = sorted(best, key=best.get)[:most]
    return out


def test_key_phrases_equal_a_plain_version(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "and", "Graph", "model", "deep", "learning", "text", ",", "(", "is", "rank", "top-k", "data"]
    rows = [(d, i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for d in range(8) for i in range(6)] + [(9, 0, None), (9, 1, "")]
    got = extraction.key_phrases(spark.createDataFrame(rows, "doc_id int, sentence_idx int, text string")).collect()
    assert {(r["doc_id"], r["sentence_idx"]): r["key_phrases"] for r in got} == plain_phrases(rows)


def test_reasoning_from_texts_alone(spark):
    papers = spark.createDataFrame([(1, "Our method uses a graph attention. The experiment shows accuracy."), (2, "Our method uses a graph attention. We propose a method."), (3, None)], "paper_id int, text string")
    got = reasoning.reason(papers)
    assert {(r["paper_id"], r["subject"], r["predicate"], r["object"]) for r in got.triples.collect()} >= {(p, "Our method", "uses", "graph attention") for p in (1, 2)}
    assert [r["evidence"] for r in got.relationships.collect()] == [["our method||uses||graph attention"]]
    units = {r["text"]: r for r in got.info_units.collect()}
    assert "graph attention" in " ".join(units["Our method uses a graph attention"]["entities"] + units["Our method uses a graph attention"]["predicates"])
    assert got.stats.first()["total_triples"] >= 3 and got.selections.count() == 0
    assert reasoning.reason(papers.limit(0)).stats.first()["papers"] == 0


def greedy(facts, most, penalty):
    """The sequential version of chosen_facts."""
    near, chosen, rest = {}, [], list(facts)
    while rest and len(chosen) < most:
        best = max(rest, key=lambda f: (round(f[1] - penalty * near.get(f[0], 0.0), 9), -f[0]))
        chosen.append(best[0])
        rest.remove(best)
        for f in rest:
            union = set(f[2]) | set(best[2])
            near[f[0]] = max(near.get(f[0], 0.0), len(set(f[2]) & set(best[2])) / len(union) if union else 0.0)
    return chosen


def test_drafts_choose_as_a_sequential_version(spark):
    rng = random.Random(3)
    rows = []
    for node in range(60):
        facts = [(i + 1, rng.randint(0, 4) / 4, sorted(set(rng.choices("abcdefgh", k=rng.randint(0, 6))))) for i in range(rng.randint(0, 12))]
        rows.append((node, facts))
    df = spark.createDataFrame(rows, "id int, facts array<struct<ord:int,score:double,words:array<string>>>")
    for most, penalty in ((6, 0.5), (3, 1.0), (4, 0.0)):
        got = {r["id"]: r["c"] for r in df.select("id", leaves.chosen_facts("facts", most, penalty).alias("c")).collect()}
        assert got == {i: greedy(f, most, penalty) for i, f in rows}


def test_leaves_of_an_outline(spark):
    docs = spark.createDataFrame([(i, f"The method number {i} uses an encoder for retrieval. It reaches an accuracy of {i} points.\nRanking helps users of system {i}.") for i in range(12)], "doc_id long, text string")
    index = reports.index(docs)
    nodes = spark.createDataFrame([("a", "Retrieval", ["encoder", "retrieval"]), ("b", "Accuracy points", None), ("c", "zzz", []), ("d", None, None)], "node_id string, title string, keywords array<string>")
    got = leaves.process_leaves(nodes, index, k=3)
    by = {r["node_id"]: r for r in got.nodes.collect()}
    assert set(by) == {"a", "b", "c", "d"} and by["a"]["draft"].startswith("## Retrieval\n\nThe method number") and by["c"]["draft"] == "## zzz\n\n" + leaves.NO_FACTS
    assert by["c"]["confidence"] == 0.2 and by["a"]["n_facts"] == 3 and by["a"]["n_citations"] == 3 and by["a"]["confidence"] > 0.5
    facts = got.facts.collect()
    assert all(f["verified"] and f["method"] == "local_exact" for f in facts) and {f["node_id"] for f in facts} == {"a", "b"}
    assert max(r["rank"] for r in got.evidence.collect()) == 3
    plain = leaves.leaf_evidence(leaves.leaf_queries(nodes), index, 3, scorer=None)
    assert plain.where("node_id = 'a'").count() == 3
    assert leaves.process_leaves(nodes.limit(0), index).nodes.count() == 0 and leaves.process_leaves(nodes, index.limit(0)).nodes.where("n_facts = 0").count() == 4


def test_verification_equals_the_expression(spark, monkeypatch):
    """Facts by token joins against the same facts with their source beside them."""
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "the", "of", "3", "4.5", "17", "delta", "concat", "cat"]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    sources = [(d, text(rng.randint(5, 60)).capitalize()) for d in range(10)] + [(10, None), (11, "")]
    facts = [(rng.randint(0, 12), text(rng.randint(1, 6)), rng.random()) for _ in range(300)]
    for d, t in sources[:10]:
        at = rng.randint(0, len(t) - 4)
        facts += [(d, t[at : at + rng.randint(1, 25)].upper(), 0.1) for _ in range(5)]
    facts += [(1, None, 0.9), (1, "", 0.9), (1, "  ", 0.9), (1, "the of", 0.0), (None, "alpha", 0.0), facts[0], facts[0]]
    f = spark.createDataFrame(facts, "source_doc int, text string, v double")
    s = spark.createDataFrame(sources, "document_id int, source_text string")
    want = f.join(s, f["source_doc"] == s["document_id"], "left").withColumn("d", scores.verification("text", F.coalesce("source_text", F.lit(""))))
    want = sorted(map(repr, want.select("source_doc", "text", "v", "d.*").collect()))
    for together in (1000, 3):
        monkeypatch.setattr(attribution, "TOGETHER", together)
        assert sorted(map(repr, attribution.verify_facts(f, s).collect())) == want
    assert len({r["method"] for r in attribution.verify_facts(f, s).collect()}) == 3
    told = attribution.verify_facts(f, s, model_score="v").collect()
    assert any(r["method"] == "llm_semantic" for r in told) and attribution.verify_facts(f.limit(0), s).count() == 0
    assert models.OfflineChat
