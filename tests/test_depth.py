import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import graph, tree


def plain_path(edges, source, target):
    """Breadth first; each step back takes the smallest node."""
    hops, at, n = {source: 0}, {source}, 0
    while at and target not in hops:
        n += 1
        at = {d for s, d in edges if s in at} - set(hops)
        hops |= dict.fromkeys(at, n)
    if target not in hops:
        return []
    path = [target]
    while path[0] != source:
        path.insert(0, min(s for s, d in edges if d == path[0] and hops.get(s) == hops[path[0]] - 1))
    return path


def test_two_sided_paths_equal_breadth_first(spark):
    r = random.Random(5)
    pairs = {(r.randrange(60), r.randrange(60)) for _ in range(120)}
    rows = [*pairs, *list(pairs)[:9], (None, 3), (4, None)]
    edges = spark.createDataFrame(rows, "src int, dst int").coalesce(1).cache()
    lengths = set()
    for _ in range(9):
        a, b = r.randrange(60), r.randrange(60)
        want = plain_path(pairs, a, b)
        lengths.add(len(want))
        got = graph.shortest_path(edges, a, b).orderBy("hop").collect()
        assert [(x["hop"], x["node"]) for x in got] == list(enumerate(want))
    assert len(lengths) > 2


def test_shortest_path_of_more_than_fifty_hops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(55)] + [(90, 91), (91, 90)], "src long, dst long")
    assert [r["node"] for r in graph.shortest_path(edges, 0, 55).orderBy("hop").collect()] == list(range(56))
    assert graph.shortest_path(edges, 90, 0).isEmpty()  # a circle ends the search too
    with pytest.raises(RuntimeError):
        graph.shortest_path(edges, 0, 55, most_hops=3)


def test_nodes_deeper_than_thirty_stay(spark):
    rows = [(i, i - 1 if i else None, 0) for i in range(36)]
    t = spark.createDataFrame(rows, "node_id long, parent_id long, ord int")
    deep = {r["node_id"]: r for r in tree.add_depth(t).collect()}
    assert {i: r["depth"] for i, r in deep.items()} == {i: i for i in range(36)} and deep[35]["path"] == list(range(36))
    with pytest.raises(RuntimeError):
        tree.add_depth(t, most_depth=2)
    with pytest.raises(ValueError):
        tree.add_depth(spark.createDataFrame([*rows[:3], (0, 2, 0)], t.schema))


def test_intervals_of_random_trees_and_deep_chains(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(0, None, 3), (1, None, 2)] + [(i, rng.randrange(i), rng.randrange(3)) for i in range(2, 60)]
    kids, want, clock = {}, {}, [0]
    for n, p, o in rows:
        kids.setdefault(p, []).append((o, n))

    def walk(n, depth):
        at = clock[0]
        clock[0] += 1
        for _, k in sorted(kids.get(n, [])):
            walk(k, depth + 1)
        want[n] = (depth, at, clock[0])
        clock[0] += 1

    for _, n in sorted(kids[None]):
        walk(n, 0)
    schema = "node_id int, parent_id int, ord int"
    df = spark.createDataFrame(rows, schema)
    assert {r["node_id"]: (r["depth"], r["enter"], r["leave"]) for r in tree.intervals(df).collect()} == want
    leaves = [n for n, *_ in rows if n not in kids]
    above = {(a, x) for x in leaves for a in want if want[a][1] < want[x][1] < want[a][2]}
    assert {(r["ancestor"], r["leaf"]) for r in tree.leaf_descendants(df).collect()} == above
    assert tree.intervals(df.limit(0)).count() == 0 and tree.leaf_descendants(df.limit(0)).count() == 0
    for bad in ([(0, None, 0), (1, 9, 0)], [(0, None, 0), (1, 2, 0), (2, 1, 0)]):
        with pytest.raises(ValueError):
            tree.intervals(spark.createDataFrame(bad, schema))
    rounds, real = [], tree.saved
    monkeypatch.setattr(tree, "saved", lambda df, name: rounds.append(name) or real(df, name))
    chain = spark.range(5000).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(0).alias("ord"))
    got = tree.intervals(chain).where("node_id IN (0, 17, 4999)").collect()
    assert {(r["node_id"], r["depth"], r["enter"], r["leave"]) for r in got} == {(0, 0, 0, 9999), (17, 17, 17, 9982), (4999, 4999, 4999, 5000)} and rounds.count("walk") <= 16
    assert tree.leaf_descendants(chain).count() == 4999
