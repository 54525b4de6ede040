"""Citation graphs as tables of edges (src, dst) and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved


def build_edges(papers: DataFrame, id_col: str = "doc_id", lists: tuple[str, ...] = ("bibliography", "references")) -> DataFrame:
    """An edge to each cited paper, parallel ones once."""
    cited = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])
    return papers.select(F.col(id_col).alias("src"), F.explode(cited).alias("dst")).distinct().withColumn("relation", F.lit("cites"))


def text_edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    from ..functions.text import cited_works

    return docs.select(F.col(id_col).cast("string").alias("src"), F.explode(cited_works(text_col, F.col(id_col).cast("string"))).alias("dst")).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int = 2, forward: bool = False) -> DataFrame:
    """(node, hop) reached from seeds (node) within depth steps: along edges, or against them if forward (who cites whom).
    hop is the least; a seed appears only if a cycle leads back to it."""
    step = edges.select(F.col("dst").alias("node"), F.col("src").alias("next")) if forward else edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    at, found = seeds.select("node").distinct(), None
    for hop in range(1, depth + 1):
        at = at.join(step, "node").select(F.col("next").alias("node")).distinct()
        level = at.withColumn("hop", F.lit(hop))
        found = level if found is None else found.union(level)
    return found.groupBy("node").agg(F.min("hop").alias("hop"))


def explore_first(edges: DataFrame, seeds: DataFrame, n: int, depth: int = 3) -> DataFrame:
    """The first n within depth steps, nearer ones and smaller ids first."""
    return k_hop(edges, seeds, depth).orderBy("hop", "node").limit(n)


def explore_parallel(edges: DataFrame, seeds: DataFrame, per_seed: int) -> DataFrame:
    """Up to per_seed cited papers of each seed, each paper once."""
    near = edges.join(seeds.select(F.col("node").alias("src")).distinct(), "src").select("src", "dst").distinct()
    nth = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return near.withColumn("n", nth).where(F.col("n") <= per_seed).select(F.col("dst").alias("node")).distinct()


def related(edges: DataFrame, seed, n: int = 5) -> DataFrame:
    """(node, score): the n nodes whose neighbours, either way, overlap the seed's most, by Jaccard; ties to smaller ids. Nodes
    share counts through their neighbours, so no neighbourhood is collected; nodes without overlap score 0."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(edges.select("dst", "src")).distinct()
    own = both.where(F.col("node") == F.lit(seed)).select("near")
    degree = both.groupBy("node").agg(F.count("*").alias("d"))
    shared = both.join(own, "near").groupBy("node").agg(F.count("*").alias("both"))
    size = own.agg(F.count("*").alias("mine"))  # one row
    scored = degree.join(shared, "node", "left").crossJoin(F.broadcast(size)).where((F.col("node") != F.lit(seed)) & (F.col("mine") > 0))
    both_n = F.coalesce("both", F.lit(0))
    return scored.select("node", (both_n / (F.col("d") + F.col("mine") - both_n)).alias("score")).orderBy(F.desc("score"), "node").limit(n)


def graph_stats(edges: DataFrame) -> DataFrame:
    """nodes, edges, density (0 for fewer than two nodes)."""
    n = nodes(edges).agg(F.count("*").alias("nodes"))
    m = edges.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    possible = F.col("nodes") * (F.col("nodes") - 1)
    return n.crossJoin(m).withColumn("density", F.when(F.col("nodes") > 1, F.round(F.col("edges") / possible, 4)).otherwise(0.0))


def _side(edges: DataFrame, at_col: str, next_col: str, node, kind) -> dict:
    start = edges.sparkSession.range(1).select(F.lit(node).cast(kind).alias("node"), F.lit(0).alias("hop"))
    start = saved(start, "path")
    return {"step": edges.select(F.col(at_col).alias("node"), F.col(next_col).alias("next")), "front": start, "seen": start, "hop": 0, "size": 1}


def _grow(side: dict) -> None:
    """One level more: what the frontier leads to and this side has not seen."""
    side["hop"] += 1
    new = side["front"].select("node").join(side["step"], "node").select(F.col("next").alias("node")).distinct()
    side["front"] = saved(new.join(side["seen"].select("node"), "node", "left_anti").select("node", F.lit(side["hop"]).alias("hop")), "path")
    side["size"] = side["front"].count()
    side["seen"] = side["seen"].union(side["front"])
    if side["hop"] % 32 == 0:  # one table again, so that long searches don't plan ever longer unions
        side["seen"] = saved(side["seen"], "path")


def _before(behind: DataFrame, at: DataFrame, step: DataFrame) -> DataFrame:
    """(node, back) for nodes of `at`, each with its smallest predecessor in `behind`."""
    return behind.select("node").join(step, "node").select(F.col("next").alias("at"), "node").join(at.select(F.col("node").alias("at")), "at").groupBy(F.col("at").alias("node")).agg(F.min("node").alias("back"))


def shortest_path(edges: DataFrame, source, target, most_hops: int | None = None) -> DataFrame:
    """(hop, node) of a shortest directed path; no rows if there is none. Of several, each step back takes the smallest node.
    Edges without a src or dst lead nowhere, repeated ones count once.

    Two frontiers, forwards from the source and backwards from the target, grow a level at a time, the smaller one first, until
    they meet or one is empty. From where they met, the backward levels are walked forwards, so that every node on a shortest
    path knows its smallest predecessor; the path is read back by doubling those pointers, in as many rounds as its length
    has binary digits. With most_hops, a search that is still open then is an error."""
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    none = spark.createDataFrame([], f"hop int, node {kind.simpleString()}")
    edges = saved(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")  # every level reads them
    there, back = _side(edges, "src", "dst", source, kind), _side(edges, "dst", "src", target, kind)
    while True:
        met = there["front"].select("node").join(back["front"].select("node"), "node")
        if not met.isEmpty():
            break
        if not there["size"] or not back["size"]:
            return none
        if most_hops is not None and there["hop"] + back["hop"] >= most_hops:
            raise RuntimeError(f"no path found in {most_hops} hops, and there are further nodes")
        _grow(min(there, back, key=lambda side: side["size"]))
    met, length = saved(met, "path"), there["hop"] + back["hop"]
    levels, at = [], met
    for left in range(back["hop"] - 1, -1, -1):  # forwards through the levels before the target
        level = _before(at, back["seen"].where(F.col("hop") == left), there["step"])
        at = saved(level, "path")
        levels.append(at)
    at = met
    for hop in range(there["hop"] - 1, -1, -1):  # and backwards to the source
        level = saved(_before(there["seen"].where(F.col("hop") == hop), at, there["step"]), "path")
        levels.append(level)
        at = level.select(F.col("back").alias("node")).distinct()
    path = spark.range(1).select(F.lit(length).alias("hop"), F.lit(target).cast(kind).alias("node"))
    if not levels:
        return path
    jump = levels[0]
    for level in levels[1:]:
        jump = jump.union(level)
    jump, reach = saved(jump, "path"), 1
    while True:
        path = saved(path.union(path.join(jump, "node").select((F.col("hop") - reach).alias("hop"), F.col("back").alias("node"))), "path")
        reach *= 2
        if reach > length:
            return path
        jump = saved(jump.join(jump.select(F.col("node").alias("back"), F.col("back").alias("further")), "back").select("node", F.col("further").alias("back")), "path")


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 1, per_level: int = 10, forward: bool = False) -> DataFrame:
    """Level by level, at most per_level new nodes each (smallest ids), none twice and no seed: (node, level)."""
    step = edges.select(F.col("dst").alias("node"), F.col("src").alias("next")) if forward else edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    seen = at = seeds.select("node").distinct()
    out = None
    for level in range(1, depth + 1):
        at = at.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").orderBy("node").limit(per_level)
        at = saved(at, "level")
        out = at.withColumn("level", F.lit(level)) if out is None else out.union(at.withColumn("level", F.lit(level)))
        seen = seen.union(at)
    return out


def search_and_expand(
    edges: DataFrame, found: DataFrame, backward: int = 1, forward: int = 0, per_paper: int = 10, order_col: str = "rank"
) -> DataFrame:
    """(node, phase, rank, level): papers that a search found (node, rank) and those around them, each once, as it comes first: phase
    0 the search, in its order; 1 along edges, `backward` levels deep; 2 against them, `forward` levels. rank is that of the
    found paper it was reached from. Every paper leads on to its per_paper smallest neighbours. Found rows without a node are
    left out. The rows' order is that of (phase, rank, level, node)."""
    seeds = found.where("node IS NOT NULL").groupBy("node").agg(F.min(order_col).alias("rank"))
    out = seeds.select("node", F.lit(0).alias("phase"), "rank", F.lit(0).alias("level"))
    for phase, depth, at_col, next_col in ((1, backward, "src", "dst"), (2, forward, "dst", "src")):
        step, at = edges.select(F.col(at_col).alias("node"), F.col(next_col).alias("next")).distinct(), seeds
        nth = F.row_number().over(Window.partitionBy("node").orderBy("next"))
        for level in range(1, depth + 1):
            near = at.join(step, "node").withColumn("nth", nth).where(F.col("nth") <= per_paper)
            at = saved(near.groupBy(F.col("next").alias("node")).agg(F.min("rank").alias("rank")), "around")
            out = out.union(at.select("node", F.lit(phase), "rank", F.lit(level)))
    first = out.groupBy("node").agg(F.min(F.struct("phase", "rank", "level")).alias("f"))
    return first.select("node", "f.phase", "f.rank", "f.level")
