"""Outline trees as tables: node_id, parent_id (null at the root), ord among siblings, title, ..."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

#: Parents up to which their figures are broadcast.
FEW = 100_000

def build_outline(spark, title: str, sections: list[dict]) -> DataFrame:
    """A root and its sections in order; a section's share in percent becomes value in 0 to 1."""
    rows = [("n0", None, 0, title, "", [], 1.0)] + [
        (f"n{i}", "n0", i - 1, s["title"], s.get("description", ""), list(s.get("keywords", [])), s.get("percent", 0) / 100.0) for i, s in enumerate(sections, 1)
    ]
    return spark.createDataFrame(rows, "node_id string, parent_id string, ord int, title string, description string, keywords array<string>, value double")


def add_depth(tree: DataFrame, most_depth: int | None = None) -> DataFrame:
    """Adds depth, path (node ids from the root), path_ord (for breadth-first order) and is_leaf; level by level from the root
    until there are no further nodes. A node that is its own ancestor, or one deeper than most_depth, is an error."""
    kind = tree.schema["node_id"].dataType.simpleString()
    level = tree.where("parent_id IS NULL").select("node_id", F.lit(0).alias("depth"), F.array("node_id").cast(f"array<{kind}>").alias("path"), F.array(F.col("ord")).alias("path_ord"))
    found = level
    for depth in count(1):
        up = level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("p"), F.col("path_ord").alias("po"))
        below = tree.join(up, "parent_id").select("node_id", F.lit(depth).alias("depth"), F.concat("p", F.array("node_id")).alias("path"), F.concat("po", F.array("ord")).alias("path_ord"))
        level = saved(below, "level")
        if level.isEmpty():
            break
        if most_depth is not None and depth > most_depth:
            raise RuntimeError(f"the tree has nodes deeper than {most_depth}")
        if not level.where(F.array_contains(F.slice("path", 1, depth), F.col("node_id"))).isEmpty():
            raise ValueError("a node of the tree is its own ancestor")
        found = found.union(level)
        if depth % 32 == 0:  # one table again, so that deep trees don't plan ever longer unions
            found = saved(found, "level")
    parents = tree.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    return tree.join(found, "node_id").join(parents, "node_id", "left").withColumn("is_leaf", F.col("inner").isNull()).drop("inner")


def add_child(tree: DataFrame, parent_id, node_id, title: str) -> DataFrame:
    """tree with one more node, the last child of its parent."""
    last = tree.where(F.col("parent_id") == F.lit(parent_id)).agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("ord"))
    kind = tree.schema["node_id"].dataType
    new = last.select(F.lit(node_id).cast(kind).alias("node_id"), F.lit(parent_id).cast(kind).alias("parent_id"), "ord", F.lit(title).alias("title"))
    return tree.unionByName(new, allowMissingColumns=True)


def siblings(tree: DataFrame) -> DataFrame:
    """(node_id, sibling_id): other children of the same parent."""
    other = tree.select("parent_id", F.col("node_id").alias("sibling_id"))
    return tree.select("node_id", "parent_id").join(other, "parent_id").where("node_id <> sibling_id").select("node_id", "sibling_id")


def sibling_counts(tree: DataFrame) -> DataFrame:
    """(node_id, n, first): of each node with siblings their number and the smallest, as counted over siblings(), but from figures of a parent: no
    pair of children is made. Rows that repeat a node count as often, other rows of the node are not its siblings."""
    each = tree.where("parent_id IS NOT NULL AND node_id IS NOT NULL").groupBy("parent_id", "node_id").agg(F.count("*").alias("m"))
    each = saved(each, "children")
    one = each.groupBy("parent_id").agg(F.sum("m").alias("all"), F.min("node_id").alias("least"))
    next_one = each.join(one, "parent_id").where("node_id > least").groupBy("parent_id").agg(F.min("node_id").alias("second"))
    figures = saved(one.join(next_one, "parent_id"), "figures")  # parents of two nodes or more
    held = each.join(F.broadcast(figures) if figures.count() <= FEW else figures, "parent_id")
    other = F.when(F.col("node_id") == F.col("least"), F.col("second")).otherwise(F.col("least"))
    return held.groupBy("node_id").agg(F.sum(F.col("m") * (F.col("all") - F.col("m"))).alias("n"), F.min(other).alias("first"))


def intervals(tree: DataFrame) -> DataFrame:
    """(node_id, depth, enter, leave): where a walk around the tree, children in the order of (ord, node_id), enters and leaves each node, from
    0. A node is below another if its enter lies between that one's enter and leave; preorder is the order of enter.

    The walk is a linked list of two steps a node; pointer doubling ranks it: each round every step learns what lies twice
    as far ahead, so a tree of n nodes takes log2(2 n) rounds of one join, however deep it is. Several roots are walked one
    after another. A node that is its own ancestor, or whose parent isn't there, is an error. An empty tree has none. Children of one
    node are put in order by one task."""
    here = tree.select("node_id", "parent_id", "ord")
    here = saved(here.withColumn("id", F.monotonically_increasing_id()), "numbered")
    among = Window.partitionBy("parent_id").orderBy("ord", "node_id")
    kin = here.select("id", "node_id", "parent_id", F.lead("id").over(among).alias("next"), F.row_number().over(among).alias("nth"))
    first = kin.where("nth = 1 AND parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id"), F.col("id").alias("child"))
    up = here.select(F.col("node_id").alias("parent_id"), F.col("id").alias("parent"))
    linked = kin.join(first, "node_id", "left").join(up, "parent_id", "left")
    linked = saved(linked.select("id", "parent_id", "parent", "next", "child"), "linked")
    if not linked.where("parent_id IS NOT NULL AND parent IS NULL").isEmpty():
        raise ValueError("a node's parent isn't in the tree")
    n = linked.count()
    one = F.lit(1).cast("long")
    enter = linked.select((2 * F.col("id")).alias("step"), F.coalesce(2 * F.col("child"), 2 * F.col("id") + 1).alias("ahead"), one.alias("rest"), one.alias("climb"))
    leave = linked.select((2 * F.col("id") + 1).alias("step"), F.coalesce(2 * F.col("next"), 2 * F.col("parent") + 1).alias("ahead"), one.alias("rest"), (-one).alias("climb"))
    state = saved(enter.union(leave), "walk")
    for turn in count(1):
        if state.where("ahead IS NOT NULL").isEmpty():
            break
        if turn > (2 * n).bit_length() + 1:
            raise ValueError("a node of the tree is its own ancestor")
        far = state.select(F.col("step").alias("ahead"), F.col("ahead").alias("further"), F.col("rest").alias("r"), F.col("climb").alias("c"))
        moved = state.join(far, "ahead", "left")
        state = saved(moved.select("step", F.col("further").alias("ahead"), (F.col("rest") + F.coalesce("r", F.lit(0))).alias("rest"), (F.col("climb") + F.coalesce("c", F.lit(0))).alias("climb")), "walk")
    at = state.select(F.floor(F.col("step") / 2).alias("id"), (F.col("step") % 2).alias("side"), (F.lit(2 * n) - F.col("rest")).alias("at"), (-F.col("climb")).alias("depth"))
    both = at.groupBy("id").agg(
        F.max(F.when(F.col("side") == 0, F.col("at"))).alias("enter"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("leave"),
        F.max(F.when(F.col("side") == 0, F.col("depth"))).cast("int").alias("depth"),
    )
    return here.select("id", "node_id").join(both, "id").select("node_id", "depth", "enter", "leave")


def leaf_descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, leaf): each leaf under every node above it. By pointer doubling from (node_id, parent_id): a round doubles how far up the
    pairs reach, so log2(depth) rounds, and no row holds a path. A node that is its own ancestor is an error."""
    up = tree.where("parent_id IS NOT NULL").select("node_id", F.col("parent_id").alias("above"))
    inner = up.select(F.col("above").alias("node_id")).distinct()
    pairs = saved(up.join(inner, "node_id", "left_anti").select(F.col("node_id").alias("leaf"), F.col("above").alias("ancestor")), "pairs")
    jumps, limit = saved(up, "jumps"), None
    for turn in count(1):
        new = pairs.join(jumps.withColumnRenamed("node_id", "ancestor"), "ancestor").select("leaf", F.col("above").alias("ancestor"))
        new = saved(new, "pairs")
        jumps = saved(jumps.join(jumps.select(F.col("node_id").alias("above"), F.col("above").alias("further")), "above").select("node_id", F.col("further").alias("above")), "jumps")
        if new.isEmpty() and jumps.isEmpty():
            return pairs.select("ancestor", "leaf")
        limit = limit or tree.count().bit_length() + 1
        if turn > limit:
            raise ValueError("a node of the tree is its own ancestor")
        pairs = saved(pairs.union(new), "pairs")


def bfs_order(deep: DataFrame) -> DataFrame:
    """Adds bfs from 1: by depth, then along the parents' order. Ranks within a depth, offset by the counts of the depths above."""
    counts = deep.groupBy("depth").agg(F.count("*").alias("c"))
    before = counts.select("depth", F.coalesce(F.sum("c").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    nth = F.row_number().over(Window.partitionBy("depth").orderBy("path_ord"))
    return deep.withColumn("nth", nth).join(F.broadcast(before), "depth").withColumn("bfs", F.col("above") + F.col("nth")).drop("nth", "above")


def roll_up(deep: DataFrame, draft_col: str = "draft") -> DataFrame:
    """(node_id, draft): a leaf's own draft; above, '## title, description' and each child as '### title' in order. From
    the deepest level up, one join a level; a report is one row in the end."""
    most = deep.agg(F.max("depth")).first()[0]
    if most is None:
        return deep.select("node_id", F.lit("").alias("draft"))
    done = deep.where("is_leaf").select("node_id", F.coalesce(draft_col, F.lit("")).alias("text"))
    for depth in range(most - 1, -1, -1):
        child = deep.where(F.col("depth") == depth + 1).select("node_id", "parent_id", "ord", "title").join(done, "node_id")
        part = F.concat(F.lit("### "), "title", F.lit("\n\n"), "text")
        merged = child.groupBy(F.col("parent_id").alias("up_id")).agg(F.sort_array(F.collect_list(F.struct("ord", "node_id", part.alias("part")))).alias("parts"))
        here = deep.where(F.col("depth") == depth).select(F.col("node_id").alias("up_id"), "title", "description")
        head = F.concat(F.lit("## "), "title", F.lit("\n\n"), F.coalesce("description", F.lit("")), F.lit("\n\n"))
        body = F.concat(head, F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n"))
        done = saved(done.union(here.join(merged, "up_id").select("up_id", body)), "rollup")
    return done.withColumnRenamed("text", "draft")


def tree_stats(deep: DataFrame) -> DataFrame:
    """One row: total_nodes, max_depth, leaves, complete, with_gaps, avg_confidence of the leaves (0 without any)."""
    return deep.agg(
        F.count("*").alias("total_nodes"), F.max("depth").alias("max_depth"), F.count_if(F.col("is_leaf")).alias("leaves"),
        F.count_if(F.coalesce("is_complete", F.lit(False))).alias("complete"), F.count_if(F.size(F.coalesce("gaps", F.array())) > 0).alias("with_gaps"),
        F.round(F.coalesce(F.avg(F.when(F.col("is_leaf"), F.col("confidence"))), F.lit(0.0)), 2).alias("avg_confidence"),
    )


def expand_gaps(tree: DataFrame, critic: Callable[[DataFrame], DataFrame], max_depth: int = 3, per_node: int = 2) -> DataFrame:
    """Grow the tree where a critic finds gaps: critic(leaves) returns (node_id, gaps). Each round looks at the leaves of the last
    depth that aren't complete; at most per_node gaps become children. Stops when there are no leaves or gaps, or at max_depth."""
    tree = tree.withColumn("is_complete", F.coalesce("is_complete", F.lit(False))) if "is_complete" in tree.columns else tree.withColumn("is_complete", F.lit(False))
    for _ in range(max_depth + 1):
        deep = add_depth(tree)
        leaves = deep.where(F.col("is_leaf") & ~F.col("is_complete") & (F.col("depth") < max_depth))
        gaps = saved(critic(leaves).select("node_id", F.posexplode(F.slice("gaps", 1, per_node)).alias("ord", "title")), "gaps")
        if gaps.isEmpty():
            break
        new = gaps.select(F.concat("node_id", F.lit("."), F.col("ord").cast("string")).alias("node_id"), F.col("node_id").alias("parent_id"), "ord", "title", F.lit(False).alias("is_complete"))
        tree = saved(tree.unionByName(new, allowMissingColumns=True), "tree")
    return tree


def duplicate_penalty(facts: DataFrame, factor: float = 0.8) -> DataFrame:
    """facts (bfs, fact_ord, text, confidence): each repeat of an earlier fact's first 100 characters loses confidence once."""
    nth = F.row_number().over(Window.partitionBy(F.substring("text", 1, 100)).orderBy("bfs", "fact_ord"))
    return facts.withColumn("confidence", F.when(nth > 1, F.col("confidence") * factor).otherwise(F.col("confidence")))


def compile_report(deep: DataFrame, drafts: DataFrame, facts: DataFrame) -> DataFrame:
    """One row, the report: counts, a table of contents of two levels and the rolled-up body."""
    ordered = deep.where("depth BETWEEN 1 AND 2").select("depth", "title", "path_ord")
    i, j = F.element_at("path_ord", 2) + 1, F.try_element_at("path_ord", F.lit(3)) + 1
    line = F.when(F.col("depth") == 1, F.format_string("%d. [%s](#section-%d)", i, "title", i)).otherwise(F.format_string("   %d.%d. [%s](#section-%d-%d)", i, j, "title", i, j))
    toc = ordered.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path_ord", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("toc"))
    head = deep.agg(F.count_if(F.col("depth") == 1).alias("sections"), F.count_if(F.col("is_leaf")).alias("leaves"), F.coalesce(F.avg(F.when(F.col("is_leaf"), F.col("confidence"))), F.lit(0.0)).alias("conf"))
    n = facts.agg(F.count("*").alias("facts"), F.count_if(F.col("verified")).alias("verified"))
    body = deep.where("depth = 0").select("node_id").join(drafts, "node_id").select("draft")
    whole = body.crossJoin(toc).crossJoin(head).crossJoin(n)  # one row each
    top = F.format_string("# Research Synthesis\n\n\n**Sections:** %d  \n\n**Sub-sections:** %d  \n\n**Facts extracted:** %d  \n\n**Verified facts:** %d  \n\n**Avg. confidence:** %.0f%%\n\n\n## Contents\n\n\n", "sections", "leaves", "facts", "verified", F.col("conf") * 100)
    return whole.select(F.concat(top, "toc", F.lit("\n\n\n\n"), "draft").alias("report"))


def append_sections(tree: DataFrame, gaps: DataFrame) -> DataFrame:
    """tree with a critic's gaps (ord, title, description, keywords) as last children of the root, all of them, in their order; a gap
    without a title is a Missing Section. Their ids are the root's, .s and the gap's ord. Without a root nothing is added."""
    root = tree.where("parent_id IS NULL").select(F.col("node_id").alias("root_id"))
    last = tree.join(root, F.col("parent_id") == F.col("root_id")).groupBy("root_id").agg((F.max("ord") + 1).alias("first"))
    at = F.broadcast(root.join(last, "root_id", "left"))  # one row, the root
    new = gaps.select(F.col("ord").alias("gap_ord"), "title", "description", "keywords").crossJoin(at)
    new = new.select(
        F.concat("root_id", F.lit(".s"), F.col("gap_ord").cast("string")).alias("node_id"), F.col("root_id").alias("parent_id"),
        (F.coalesce("first", F.lit(0)) + F.col("gap_ord")).cast("int").alias("ord"), F.coalesce("title", F.lit("Missing Section")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
    )
    return tree.unionByName(new, allowMissingColumns=True)


def node_citations(facts: DataFrame, node_col: str = "node_id", source_col: str = "source_doc") -> DataFrame:
    """(node_id, citation): each source that a node's facts name, once, as [source]; facts without a source give none. One row a
    citation, so that a node with many never becomes one large row."""
    named = facts.where(F.coalesce(F.col(source_col).cast("string"), F.lit("")) != "")
    return named.select(F.col(node_col).alias("node_id"), F.concat(F.lit("["), F.col(source_col).cast("string"), F.lit("]")).alias("citation")).distinct()


def node_records(deep: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The nodes as reports list them: id, title, description, depth, facts_count, draft_preview (200 characters), confidence and value
    to two places, is_leaf, is_complete, children_count, parent. Columns that the tree lacks count as empty, 0 or false."""
    has = lambda c, other: F.coalesce(c, F.lit(other)) if c in deep.columns else F.lit(other)
    children = deep.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    wide = deep.join(children, "node_id", "left")
    if facts is None:
        wide = wide.withColumn("facts", F.lit(0).cast("long"))
    else:
        wide = wide.join(facts.groupBy("node_id").agg(F.count("*").alias("facts")), "node_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return wide.select(
        F.col("node_id").alias("id"), "title", has("description", "").alias("description"), "depth", count("facts").alias("facts_count"),
        F.substring(has("draft", ""), 1, 200).alias("draft_preview"), F.round(has("confidence", 0.0), 2).alias("confidence"),
        F.round(has("value", 0.0), 2).alias("value"), "is_leaf", has("is_complete", False).alias("is_complete"),
        count("children").alias("children_count"), F.col("parent_id").alias("parent"),
    )
