import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import scores, text, vectors


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in row.items()))
    return df.select(column.alias("x")).first()["x"]


def test_headings(spark):
    yes = ["1. Introduction", "2.3 Methods", "ABSTRACT", "RESULTS AND DISCUSSION", "Related Work"]
    no = ["This is a normal sentence.", "", "  "]
    rows = spark.createDataFrame([(x,) for x in yes + no], "t string").select("t", text.is_heading("t").alias("h")).collect()
    assert {r["t"] for r in rows if r["h"]} == set(yes)
    main = spark.createDataFrame([("1. Introduction",), ("Related Work",), ("Zebra Crossing",)], "t string").select(text.is_main_heading("t").alias("h")).collect()
    assert [r["h"] for r in main] == [True, True, False]


def test_sentences_and_citations(spark):
    assert value(spark, text.sentences("t"), t="First sentence. Second sentence! Third? Fourth with no ending") == ["First sentence.", "Second sentence!", "Third?", "Fourth with no ending"]
    rows = spark.createDataFrame([("A [1].",), ("B [doc_1].",), ("C.",)], "t string").select(text.has_citation("t").alias("h")).collect()
    assert [r["h"] for r in rows] == [True, True, False]
    assert value(spark, text.cited_works("t", F.lit("d")), t="x [Smith et al. 2020] y [12]") == ["Smith et al. 2020", "d_ref_12"]


def test_golden_ids(spark):
    assert value(spark, text.theme_id("q"), q="fault location") == "fault-location_39f1a5bc66c26754"
    assert value(spark, text.theme_id("q"), q="CNN fault location transmission line") == "cnn-fault-location-transmission-line_52eca12c0e211c2f"
    assert value(spark, text.cache_key(F.lit("paper"), "q"), q="test_paper") == "340ea04e5fc0b16b3fa76f698bb265f5"
    assert value(spark, text.cache_key(F.lit("search"), "q"), q="search:neural retrieval:2:None:None") == "f6be7b8cd2adcd29ce2bf3a570e2e682"
    assert value(spark, text.fingerprint("doi", "title"), doi=" 10.1/AB ", title="x") == "doi:10.1/ab"


def spans(t, size, overlap):
    """The windows one after another."""
    out, at = [], 0
    while at < len(t):
        end = min(at + size, len(t))
        if end < len(t):
            for sep in ("\n\n", ". ", "\n"):
                where = t[at:end].rfind(sep)
                if where > size // 2:
                    end = at + where + len(sep)
                    break
        out.append((at, end))
        at = end if end == len(t) else end - overlap
    return out


def test_chunks_match_a_sequential_version(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", " ", ". ", "\n", "\n\n", "é"]) for _ in range(rng.randint(0, 700))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for row in df.select("i", text.chunk_spans("t", 60, 10).alias("s")).collect():
        assert [(s["start"], s["end"]) for s in row["s"]] == spans(texts[row["i"]], 60, 10)
    assert value(spark, text.chunk_spans("t"), t=None) == []
    with pytest.raises(ValueError):
        text.chunk_spans("t", 100, 50)


def test_parsers(spark):
    assert value(spark, text.parse_gaps("t"), t="GAPS: a | b |") == ["a", "b"]
    assert value(spark, text.parse_gaps("t"), t="no gaps here") == []
    assert value(spark, text.parse_gaps("t"), t="- a line that is long enough to keep\nshort") == ["a line that is long enough to keep"]
    assert value(spark, text.parse_decision("t"), t='SEARCH: "more on x"').asDict() == {"action": "SEARCH", "follow_up": "more on x"}
    assert value(spark, text.parse_decision("t"), t="Yes.")["action"] == "ANSWER"
    assert tuple(value(spark, text.parse_paper_tag("t"), t="[P1]T")) == ("P1", "T")
    assert tuple(value(spark, text.parse_paper_tag("t"), t="P1")) == ("P1", "M")
    assert tuple(value(spark, text.parse_outline_line("t"), t="1. Title: what it is")) == ("Title", "what it is")
    assert value(spark, F.to_json(text.json_answer("t")), t='```json\n{"a": 1}\n```') == '{"a":1}'
    assert value(spark, F.to_json(text.json_answer("t")), t='so {"a": 1} it is') == '{"a":1}'
    assert value(spark, text.marked_response("t"), t="x [Response_Start] y\nz [Response_End]") == "y\nz"
    assert value(spark, text.safe_filename("t"), t='a<b>: "c" .') == "a_b_c_"
    assert value(spark, text.safe_filename("t"), t="con") == "_con"
    assert value(spark, text.expand_query("t"), t="Deep Search") == "deep search retrieval augmented generation iterative"
    assert value(spark, text.source_urls("t"), t="[a](https://x.y) and [b](https://x.y)") == ["https://x.y"]
    assert value(spark, text.phrase_kind("t"), t="We propose it") == "predicate"


def test_classifier(spark):
    assert value(spark, scores.primary_tag("t"), t="An experiment with a benchmark dataset") == "E"
    assert value(spark, scores.primary_tag("t"), t="nothing") == "T"
    top = value(spark, scores.top_tags(scores.tag_scores("t"), 2), t="method and experiment")
    assert [(s["tag"], float(s["score"])) for s in top] == [("E", 1.0), ("M", 1.0)]


def test_support_and_verification(spark):
    v = lambda f, s: value(spark, scores.verification("f", "s"), f=f, s=s)
    assert tuple(v("the cat sat", "There The Cat Sat down")) == (True, 1.0, "local_exact")
    assert tuple(v("cats 12 dogs 13", "cats 12")) == (False, pytest.approx(0.5), "local_partial")
    assert v("", "x")["method"] == "none"


def test_sufficiency_reproduces_a_saved_verdict(spark):
    df = spark.createDataFrame([(5, 5, 0)], "v long, t long, g long")
    got = df.select(scores.sufficiency("v", "t", "g", "hybrid_v2").alias("s")).first()["s"]
    assert (got["passed"], got["reason"], got["score"]) == (False, "hybrid_v2_gate:pool_too_small", pytest.approx(1.0))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    got = df.select(vectors.l2_normalize("a").alias("a"), vectors.l2_normalize("z").alias("z"), vectors.cosine("a", "a").alias("c"), vectors.cosine("a", "z").alias("n")).first()
    assert got["a"] == pytest.approx([0.6, 0.8]) and got["z"] == [0.0, 0.0] and got["c"] == pytest.approx(1.0) and got["n"] == 0.0
