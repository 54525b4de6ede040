"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, shuffle_width, stored

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def targets(sizes: DataFrame, most: int = MOST_EPOCHS, budget: int | None = None) -> DataFrame:
    """sizes: one row a source (source, source_size). Sources by code point, null last, weigh 1, 2, 3, repeating.

    A source's share of the budget (default: all sizes) follows its weight but stops at `most` times its size; what
    is above goes to the others by weight until none is above. That is a level L with target = min(cap, L * weight):
    in the order of cap / weight, the first k sources are capped, the least k that leaves no other one above.
    Returns source, source_size, weight, target.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    w = sizes.withColumn("nth", F.row_number().over(by_name)).withColumn("weight", ((F.col("nth") - 1) % 3 + 1).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", "nth").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("level", "nth").rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) if budget is None else F.lit(budget).cast("long")
    w = w.withColumn("left", total - F.coalesce(F.sum("cap").over(order), F.lit(0))).withColumn("open", F.sum("weight").over(rest))
    fits = F.when(F.col("level") >= F.col("left") / F.col("open"), F.struct("level", "nth", "left", "open"))
    w = w.withColumn("cut", F.min(fits).over(Window.partitionBy()))
    capped = F.col("cut").isNull() | (F.struct("level", "nth") < F.struct("cut.level", "cut.nth"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("cut.left") / F.col("cut.open") * F.col("weight"))
    return w.select("source", "source_size", "nth", "weight", target.alias("target"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST_EPOCHS) -> DataFrame:
    """What the mix takes of every row, and when.

    Sources follow a schedule over training time t in [0, 1]: the k-th one's weight runs straight from 1.5 to 0.5 times
    its mean for odd k, from 0.5 to 1.5 for even k. Its integral D(t) is the source's cumulative demand, D(1) its
    target. A source's rows in the order of md5(id) form a tape, read up to `most` times over; the words demanded by t
    end at D(t), so a row that begins at c words is read at t with D(t) = c. The tape stops at the target: the row there
    is read in part, so that a source's taken words are its target rounded down.

    Prefix sums have two levels, (source, leading digits of md5) and then those blocks, so a source with any share of
    the rows is spread over tasks. Null text has size 0 and is never taken; null sources form a source of their own.
    Rows with equal id are ordered by size and the text's md5, so reruns agree.

    Returns id_col, size, source_size, target, taken, copies (whole readings), first_position (null if none), positions (of each
    reading, the last maybe in part), start, nth, md5, source.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), F.md5(text.cast("binary")).alias("md5"))
    rows = stored(rows.withColumn("block", F.substring("key", 1, 3)), "sizes")
    blocks = stored(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    by = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a source
    goal = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), most)
    offsets = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("words").over(by), F.lit(0)).alias("before"))
    goal = goal.withColumnRenamed("source", "s2")
    offsets = stored(offsets.join(goal, F.col("s").eqNullSafe(F.col("s2"))).drop("s2"), "offsets")
    here = Window.partitionBy("source", "block").orderBy("key", "id", "size", "md5").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("within", F.sum("size").over(here) - F.col("size"))
    side = broadcast_if_small(offsets, 20_000)
    placed = placed.join(side, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("start", F.col("before") + F.col("within"))
    stop = F.floor("target")
    read = [F.least(F.col("size"), F.greatest(F.lit(0), stop - F.col("start") - e * F.col("source_size"))) for e in range(most)]
    a, b = F.when(F.col("nth") % 2 == 1, 1.5).otherwise(0.5), F.when(F.col("nth") % 2 == 1, 0.5).otherwise(1.5)
    share = [(F.col("start") + e * F.col("source_size")) / F.col("target") for e in range(most)]  # D(t) / D(1) = a t + (b - a) t^2 / 2
    t = [F.round((F.sqrt(a * a + 2 * (b - a) * x) - a) / (b - a), 9) for x in share]
    taken = sum(read[1:], read[0])
    return placed.select(
        F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"),
        sum((F.when((r == F.col("size")) & (F.col("size") > 0), 1).otherwise(0) for r in read[1:]), F.when((read[0] == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).alias("copies"),
        F.when(taken > 0, t[0]).alias("first_position"), F.array_compact(F.array(*[F.when(r > 0, x) for r, x in zip(read, t)])).alias("positions"), "start", "nth", "md5", "source",
    )


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST_EPOCHS) -> DataFrame:
    """curriculum's rows in the order of training: range-sorted by first position, rows that are never read last; ties by id."""
    order = [F.col("first_position").asc_nulls_last(), F.col(id_col).asc_nulls_first()]
    plan = curriculum(docs, id_col, text_col, source_col, most).select(
        id_col, "size", "source_size", "target", "taken", "copies", "first_position", F.try_element_at("positions", F.lit(-1)).alias("last_position"), "positions"
    )
    plan = stored(plan, "schedule")  # else the sample for the ranges repeats the work
    return plan.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: whole rows of docs, each once for every reading whose middle word the target covers (so a source is
    within half a row of its target), range-sorted by training position. All columns stay. Rows without words demand
    no words: they stay once, at their place on the tape."""
    plan = curriculum(docs, id_col, text_col, source_col, most)
    size = F.col("size")
    begins = [F.col("start") + e * F.col("source_size") for e in range(most)]
    copies = F.filter(F.array(*[F.when(F.when(size > 0, b + size / 2 <= F.col("target")).otherwise(F.lit(e == 0)), b.cast("double")) for e, b in enumerate(begins)]), lambda x: x.isNotNull())
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("begin"), F.col("target")), F.lit(0.0)))
    a, b = F.when(F.col("nth") % 2 == 1, 1.5).otherwise(0.5), F.when(F.col("nth") % 2 == 1, 0.5).otherwise(1.5)
    t = (F.sqrt(a * a + 2 * (b - a) * share) - a) / (b - a)
    numbered = plan.withColumn("begin", F.explode(copies)).withColumn("evidentia_nth", F.lit(1))
    text = F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary"))
    docs = docs.withColumn("evidentia_md5", text)
    if not plan.groupBy(id_col, "md5").count().where("count > 1").isEmpty():  # equal rows: the n-th of each side belong together
        numbered = numbered.withColumn("evidentia_nth", F.dense_rank().over(Window.partitionBy(id_col, "md5").orderBy("start")))
        docs = docs.withColumn("evidentia_nth", F.row_number().over(Window.partitionBy(id_col, "evidentia_md5").orderBy(F.lit(1))))
    else:
        docs = docs.withColumn("evidentia_nth", F.lit(1))
    readings = numbered.select(F.col(id_col).alias("evidentia_id"), F.col("md5").alias("evidentia_p_md5"), F.col("evidentia_nth").alias("evidentia_p_nth"), t.alias("evidentia_position"))
    same = docs[id_col].eqNullSafe(readings["evidentia_id"]) & (docs["evidentia_md5"] == readings["evidentia_p_md5"]) & (docs["evidentia_nth"] == readings["evidentia_p_nth"])
    out = docs.join(readings, same).drop("evidentia_id", "evidentia_p_md5", "evidentia_p_nth", "evidentia_md5", "evidentia_nth")
    width = shuffle_width(docs.sparkSession)
    return out.repartitionByRange(width, "evidentia_position").sortWithinPartitions("evidentia_position").drop("evidentia_position")
