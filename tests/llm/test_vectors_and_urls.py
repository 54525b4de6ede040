import numpy as np

from evidentia.llm import ann, url_filter

V = "vec_id long, embedding array<float>, label int, cell int"


def brute(x, ids, q, k):
    d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
    order = sorted((d[i], ids[i]) for i in range(len(ids)) if ids[i] != q)
    return [i for _, i in order[:k]]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[50:90] = x[50]  # ties
    rows = [(i, x[i].tolist(), 0, 7) for i in range(600)]
    rows += [(1000, None, 0, 7), (1100, [0.0] * 16, 0, 7), (1200, [float("nan")] * 16, 0, 7), (1300, [None] + [1.0] * 15, 0, 7), (1400, [float("inf")] * 16, 0, 7), (100, x[100].tolist(), 0, 7)]
    df = spark.createDataFrame(rows, V)
    got = ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 600, 50))
    hits = 0
    for q, found in by.items():
        assert [r["rank"] for r in found] == list(range(1, 11)) and q not in [r["vec_id"] for r in found]
        for r in found:
            assert r["score"] == float(np.sqrt(((x[q].astype(float) - x[r["vec_id"]].astype(float)) ** 2).sum())) or abs(r["score"] - np.linalg.norm(x[q].astype(float) - x[r["vec_id"]].astype(float))) < 1e-12
        hits += len({r["vec_id"] for r in found} & set(brute(x.astype(float), list(range(600)), q, 10)))
    assert hits / (10 * len(by)) >= 0.9
    assert [r["vec_id"] for r in by[50]] == list(range(51, 61))  # equal vectors: the smaller ids
    few = spark.createDataFrame(rows[:4], V)
    assert [(r["query_id"], r["rank"]) for r in ann.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1), (0, 2), (0, 3)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann.nearest(df, df.where("vec_id >= 1000")).count() == 0


def test_neighbours_of_vectors_of_mixed_lengths(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)] + [(100 + i, [1.0] * (3 + i % 4)) for i in range(20)], "vec_id long, embedding array<float>")
    got = ann.nearest(rows, rows, 3, share=1.0).collect()
    assert {r["query_id"] for r in got} == set(range(30)) and all(r["vec_id"] < 30 for r in got) and len(got) == 90


def test_traverse_goes_by_summed_distance():
    rng = np.random.default_rng(2)
    d1, d2, counts = rng.random(6), rng.random(7), np.ones(42, int)
    cells = ann.traverse(d1, d2, counts, 42)
    sums = [d1[c // 7] + d2[c % 7] for c in cells]
    assert len(cells) == 42 and sums == sorted(sums) and ann.traverse(d1, d2, counts, 5) == cells[:5]


P = "page_id long, url string, html string, host string, path string, rule string"


def test_urls(spark):
    link = '<a href="https://good.example.org/x">g</a>'
    bad = '<a href="http://BAD.com/de/y">b</a>'
    rows = [
        (1, "https://Good.Example.org/en/2", "", "", "", ""), (2, "http://a.example.org/es/?q=1", "", "", "", ""), (3, "http://bad.com/de/y#t", "", "", "", ""),
        (4, "http://spam.net/x", bad * 5, "", "", ""), (5, "http://kind.net/x", "", "", "", ""), (6, None, None, "", "", ""), (7, "no url", "", "", "", ""),
        (8, "http://notexample.org", link, "", "", ""), (9, "http://example.org/en/12?x", "", "", "", ""), (10, "x://COM/fr/é", None, "", "", ""), (10, "x://COM/fr/é", None, "", "", ""), (11, "http://comx/fr/", "", "", "", ""),
    ]
    got = [r.asDict() for r in url_filter.judge(spark.createDataFrame(rows, P)).collect()]
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("good.example.org", "/en/2", "org/", "allow") and by[2] == ("a.example.org", "/es/", "example.org/es/", "block")
    assert by[3] == ("bad.com", "/de/y", "com/de/", "block") and by[4] == ("spam.net", "/x", None, "block") and by[5] == ("kind.net", "/x", None, "allow")
    assert by[6] == ("", "", None, "allow") and by[7] == ("", "", None, "allow") and by[8] == ("notexample.org", "", None, "allow")
    assert by[9] == ("example.org", "/en/12", "example.org/en/1", "block") and by[10] == ("com", "/fr/é", "com/fr/", "allow") and by[11][2] is None
    assert url_filter.judge(spark.createDataFrame([], P)).count() == 0
