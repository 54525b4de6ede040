"""Cases beyond what a bound on rounds, margins or columns would let through."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import mixing, queries, url_filter

PAGES = "page_id long, url string, html string"


def verdicts(pages):
    return {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).where("page_id < 10000").collect()}


def test_url_verdicts_do_not_depend_on_unrelated_pages(spark):
    """1,000 hosts link to a blocked one; with 300,000 more ruled pages elsewhere each has a distrust of about 4e-10."""
    link = F.lit('<a href="http://bad.com/de/y">b</a>')
    linkers = spark.range(1000).select(F.col("id").alias("page_id"), F.format_string("http://s%d.net/x", "id").alias("url"), link.alias("html"))
    graph = linkers.union(spark.createDataFrame([(1000, "http://bad.com/de/y", ""), (1001, "http://alone.net/", "")], PAGES))
    others = spark.range(300_000).select((F.col("id") + 10_000).alias("page_id"), F.lit("http://u.org/").alias("url"), F.lit("").alias("html"))
    want = {i: "block" for i in range(1001)} | {1001: "allow"}
    assert verdicts(graph) == want and verdicts(graph.union(others)) == want


def test_url_scores_reach_the_end_of_a_chain_and_settle(spark):
    """20 hosts in a chain that ends in a blocked page, and a circle of trust and distrust against exact PageRank."""
    link = lambda h: f'<a href="http://{h}/x">l</a>'
    rows = [(i, f"http://s{i}.net/x", link(f"s{i + 1}.net" if i < 19 else "bad.com")) for i in range(20)] + [(20, "http://bad.com/de/y", "")]
    rows += [(21, "http://good.org/", link("c0.net"))] + [(22 + i, f"http://c{i}.net/x", link(f"c{(i + 1) % 3}.net") + (link("bad.com") if i == 1 else "")) for i in range(3)]
    got = url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} >= set(range(21))
    hosts = sorted({r["host"] for r in got})
    n = {h: i for i, h in enumerate(hosts)}
    links = np.zeros((len(hosts), len(hosts)))
    for _, url, html in rows:
        for h in hosts:
            links[n[url.split("/")[2]], n[h]] += html.count(f"//{h}/")
    for column, m, seed in (("trust", links, "good.org"), ("distrust", links.T, "bad.com")):
        share = m / np.maximum(m.sum(1, keepdims=True), 1)
        start = np.zeros(len(hosts))
        start[n[seed]] = 0.15 / 2
        want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * share.T, start)
        for r in got:
            assert abs(r[column] - want[n[r["host"]]]) <= 1e-9 * want[n[r["host"]]]


def test_url_scores_of_hubs_dealt_over_tasks(spark, monkeypatch):
    edges = [("allow", f"s{i}", f"s{i + 1}", 1.0) for i in range(20)] + [("block", "hub", f"h{i}", 1 / 50) for i in range(50)] + [("block", f"h{i}", "hub", 1.0) for i in range(50)]
    edges = spark.createDataFrame(edges + [("allow", "x", "y", 1.0)], "kind string, src string, dst string, share double")
    seeds = spark.createDataFrame([("allow", "s0", 0.5), ("block", "hub", 0.3), ("block", "alone", 0.2)], "kind string, host string, seed double")
    told = lambda: {(r["kind"], r["host"]): r["score"] for r in url_filter.propagate(edges, seeds, damping=0.3).collect()}
    one = told()
    assert len(one) == 21 + 51 + 1 and one["allow", "s20"] == pytest.approx(0.5 * 0.7 * 0.3**20) and one["block", "alone"] == pytest.approx(0.2 * 0.7)
    assert one["block", "hub"] == pytest.approx(0.3 * 0.7 / (1 - 0.3**2), 1e-9)
    monkeypatch.setattr(url_filter, "is_small", lambda *_: False)
    monkeypatch.setattr(url_filter, "HEAVY", 8)
    jobs = told()
    assert set(jobs) == set(one) and all(jobs[k] == pytest.approx(one[k], 1e-9) for k in one)


def test_url_verdicts_on_a_deep_graph(spark):
    """A chain of 130 hosts, each linked by 400 others, to a blocked one: their scores fall under the smallest doubles, all are blocked."""
    link = lambda h: f'<a href="http://{h}/x">l</a>'
    rows = [(i, f"http://s{i}.net/x", link(f"s{i + 1}.net" if i < 129 else "bad.com")) for i in range(130)] + [(130, "http://bad.com/de/y", "")]
    rows += [(1000 + 400 * i + j, f"http://f{i}x{j}.net/", link(f"s{i}.net")) for i in range(130) for j in range(400)]
    rows += [(999_999, "http://good.org/", ""), (999_998, "http://other.net/", "")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows) and {i for i, v in got.items() if v == "allow"} == {999_999, 999_998}


def reached_at(share, odd):
    """When the integral of a source's weight comes to this share of its total, by bisection."""
    a, b = (1.5, 0.5) if odd else (0.5, 1.5)
    low, high = 0.0, 1.0
    for _ in range(60):
        t = (low + high) / 2
        low, high = (t, high) if a * t + (b - a) * t * t / 2 < share else (low, t)
    return low


def test_curriculum_query_gives_positions_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40) if i % 9 else None, rng.choice(["a", "b", "c", "c", "c", None])) for i in range(300)]
    rows += [(1000 + i, "w " * 9, "bb") for i in range(3)]  # a small source, read several times
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in mixing.schedule(queries.table(spark, str(tmp_path), "documents")).collect()]
    assert list(got[0])[:5] == ["doc_id", "size", "source_size", "target", "taken"] and sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    by = {r["doc_id"]: r for r in got}
    words = {i: len((text or "").split()) for i, text, _ in rows}
    for nth, source in enumerate(["a", "b", "bb", "c", None], 1):
        tape = sorted((i for i, _, s in rows if s == source), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        target, begin, want = by[tape[0]]["target"], 0, {i: [] for i in tape}
        for _ in range(3):
            for i in tape:
                if words[i] and begin < int(target):
                    want[i].append(reached_at(begin / target, nth % 2))
                begin += words[i]
        for i in tape:
            assert by[i]["positions"] == pytest.approx(want[i], abs=2e-9) and by[i]["first_position"] == (by[i]["positions"] or [None])[0]
    assert any(len(r["positions"]) == 3 for r in got) and any(not r["positions"] and r["size"] for r in got)
    order = [(r["first_position"] is None, r["first_position"] or 0, r["doc_id"]) for r in got]
    assert order == sorted(order)
