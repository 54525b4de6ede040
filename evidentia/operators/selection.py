"""Coverage-budgeted selection of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import TAGS
from ..functions.vectors import let


def budgets(target: int, mode: str = "balanced") -> dict[str, int]:
    """How many papers each tag may have at first: an even split, the remainder in tag order; diverse gives every tag one
    at least, also where that exceeds the target."""
    if target <= 0:
        return dict.fromkeys(TAGS, 0)
    even = {t: target // len(TAGS) + (i < target % len(TAGS)) for i, t in enumerate(TAGS)}
    return {t: max(1, n) for t, n in even.items()} if mode == "diverse" else even


def select_evidence(candidates: DataFrame, target: int, mode: str = "balanced", rank_col: str = "rank", id_col: str = "paper_id", tag_col: str = "tag") -> DataFrame:
    """Of candidates (id, tag, rank): first the best of each tag within its budget, then, up to the target, one of each tag in turn
    from what is left. A closed form of two ranks: beyond its budget a tag's n-th left-over comes in the n-th turn.

    Only rows that could be chosen reach the second, undivided ranking: those within budget plus target of their tag,
    so at most five times the target. Unknown and null tags count as T. Adds pass (1 or 2) and position.
    """
    budget = budgets(target, mode)
    tag = F.coalesce(let(F.col(tag_col), lambda t: F.when(t.isin(*TAGS), t)), F.lit("T"))
    per_tag = F.element_at(F.create_map(*[F.lit(x) for t in TAGS for x in (t, budget[t])]), F.col("tag"))
    order = F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(TAGS) for x in (t, i)]), F.col("tag"))
    ranked = candidates.select(F.col(id_col).alias("paper_id"), tag.alias("tag"), F.col(rank_col).alias("rank"))
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("tag").orderBy("rank", "paper_id")))
    ranked = ranked.where(F.col("n") <= max(budget.values()) + target)  # a bound on the rank itself limits each task's rows
    ranked = ranked.withColumn("turn", F.col("n") - per_tag).where(F.col("turn") <= target).withColumn("tag_order", order).withColumn("pass", F.when(F.col("turn") <= 0, 1).otherwise(2))
    first = Window.orderBy("pass", F.when(F.col("pass") == 1, F.col("tag_order")).otherwise(F.col("turn")), F.when(F.col("pass") == 1, F.col("n")).otherwise(F.col("tag_order")))
    ranked = ranked.withColumn("position", F.row_number().over(first))
    return ranked.where((F.col("pass") == 1) | (F.col("position") <= target)).select("paper_id", "tag", "rank", "pass", "position")


def coverage_report(selected: DataFrame, target: int, mode: str = "balanced") -> DataFrame:
    """tag, selected, budget, note: under-covered tags are named. Every tag has a row."""
    spark = selected.sparkSession
    plan = spark.createDataFrame([(t, n) for t, n in budgets(target, mode).items()], "tag string, budget int")
    counts = selected.groupBy("tag").agg(F.count("*").alias("selected"))
    joined = F.broadcast(plan).join(counts, "tag", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    note = F.format_string("Under-covered tag %s: selected %d vs budget %d", "tag", "selected", "budget")
    return joined.withColumn("note", F.when(F.col("selected") < F.col("budget"), note))


def clusters(selected: DataFrame, target: int, mode: str = "balanced") -> DataFrame:
    """(cluster_id, cluster_label, paper_id, nth, n, budget, note): the chosen papers by tag, in the order of their selection, a row each, so
    that a large cluster is no large row. Tags without papers have none."""
    budget = budgets(target, mode)
    plan = F.element_at(F.create_map(*[F.lit(x) for t in TAGS for x in (t, budget[t])]), F.col("tag"))
    n = F.count("*").over(Window.partitionBy("tag"))
    nth = F.row_number().over(Window.partitionBy("tag").orderBy("position"))
    told = selected.select("tag", "paper_id", nth.alias("nth"), n.alias("n"))
    return told.select(
        F.concat(F.lit("cluster_"), "tag").alias("cluster_id"), F.concat(F.lit("PrimaryTag:"), "tag").alias("cluster_label"), "paper_id", "nth", "n",
        plan.alias("budget"), F.format_string("Selected %d for tag %s", "n", "tag").alias("note"),
    )


def evidence_fingerprint(ids: DataFrame, id_col: str = "paper_id", by: list[str] | None = None) -> DataFrame:
    """sha256 of a set's sorted ids, one a line: the same for any order. For evidence sets, whose size a target bounds."""
    digest = F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(id_col).cast("string"))), "\n"), 256).alias("fingerprint")
    return ids.groupBy(*by).agg(digest, F.countDistinct(id_col).alias("n")) if by else ids.agg(digest, F.countDistinct(id_col).alias("n"))


def tag_counts(df: DataFrame, by: list[str], tag_col: str = "tag") -> DataFrame:
    """A column for each tag, zeros included."""
    return df.groupBy(*by).pivot(tag_col, list(TAGS)).count().fillna(0, list(TAGS))
