"""Chat formatting in budgeted, turn-aligned windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, spread_join, stored

#: The template: a header line with the percent-encoded role, the escaped text, a closing line.
HEAD, CLOSE = "### ", "\n</turn>\n"
#: A token, for the budget: a run of letters and digits, or any other visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
BLOCK = 64


def escape(text: Column) -> Column:
    """Reversible, and the result holds neither ### nor </turn>: a backslash becomes \\s, ### becomes \\h\\h\\h and the < of
    </turn> becomes \\l."""
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(text, F.lit("###"), F.lit("\\h\\h\\h")), F.lit("</turn>"), F.lit("\\l/turn>"))


def unescape(text: Column) -> Column:
    """Each backslash of an escaped text begins one of three marks, so they are replaced one after another, \\s last."""
    text = F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\s"), F.lit("\\"))


def turn_head(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.url_encode(role), F.lit("\n"))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def format_windows(
    turns: DataFrame, window_tokens: int = 1024, history_turns: int = 2, history_tokens: int = 256,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Format every conversation as windows of whole turns.

    Turns are ordered by (turn, role, text). Prefix sums of their tokens, those of the template included, so that turns without
    text count too, cut a conversation: with half = half of what window_tokens leaves beside the history and the first system turn,
    the turns whose tokens begin in one stretch of `half` tokens share a window, and a turn of more than `half` tokens has one of
    its own. Each later window repeats the conversation's first turn if its role is system, then up to history_turns turns before
    its own that lie within history_tokens; beside a long system turn the history shrinks, to nothing if it must, so that an
    eighth of the window is left for new turns. So a window stays within window_tokens unless one turn alone is longer than what the
    system turn leaves: turns are never cut, and such a turn has a window to itself. A system turn of window_tokens or more leaves
    nothing: then every turn has its own window. The loss mask covers assistant texts where they are new; repeats are masked.

    Prefix sums have two levels, blocks of 64 turn numbers and their totals, so one huge conversation is spread over
    tasks; turns with one number (or none) are one block, numbered in one task. Null role or text: empty. A null conv_id is a conversation of its own; equal rows are turns of their own.

    Returns one row a window: conv, window, formatted, loss (array of start and length, in code points), n_context (leading
    repeated turns), n_new. Empty in, empty out.
    """
    conv = F.col(conv_col)
    src = turns.select(
        conv.alias("conv"), F.when(conv.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), conv.cast("string"))).alias("ck"),
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    src = src.withColumn("tokens", token_count(F.concat(turn_head(F.col("role")), escape(F.col("text")), F.lit(CLOSE))))
    src = src.withColumn("block", F.expr(f"coalesce(floor(turn / {BLOCK}), -9223372036854775808)"))
    inner = Window.partitionBy("ck", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    src = src.withColumn("nth", F.row_number().over(inner)).withColumn("upto", F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    src = stored(src, "turns")
    leads = F.max(F.when((F.col("nth") == 1) & (F.col("role") == "system"), F.col("tokens")).otherwise(F.lit(0)))
    blocks = src.groupBy("ck", "block").agg(F.max("nth").alias("n"), F.sum("tokens").alias("t"), leads.alias("s"))
    order = Window.partitionBy("ck").orderBy("block")
    outer = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    first = F.first("s").over(order.rowsBetween(Window.unboundedPreceding, 0))  # the tokens of a conversation's system turn
    blocks = blocks.select("ck", "block", F.coalesce(F.sum("n").over(outer), zero).alias("n0"), F.coalesce(F.sum("t").over(outer), zero).alias("t0"), first.alias("s_tokens"))
    placed = src.join(broadcast_if_small(stored(blocks, "blocks")), ["ck", "block"]).select(
        "conv", "ck", "role", "text", "tokens", "s_tokens", (F.col("n0") + F.col("nth") - 1).alias("pos"), (F.col("t0") + F.col("upto") - F.col("tokens")).alias("start")
    )
    systems = placed.where("pos = 0 AND role = 'system'").select("ck", F.col("role").alias("s_role"), F.col("text").alias("s_text"))
    systems = stored(systems, "systems")
    room = F.lit(window_tokens) - F.col("s_tokens")
    placed = placed.withColumn("past", F.greatest(F.lit(0), F.least(F.lit(history_tokens), room - window_tokens // 8)))
    placed = placed.withColumn("half", F.floor(F.greatest(F.lit(1), room - F.col("past")) / 2))
    # A window's key: the stretch its turns begin in; a long turn and what follows it in the same stretch part there.
    own = F.col("tokens") > F.col("half")
    longs = Window.partitionBy("ck", "cell").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("cell", F.floor(F.col("start") / F.greatest(F.col("half"), F.lit(1)))).withColumn("own", own)
    placed = placed.withColumn("sub", 2 * F.sum(F.col("own").cast("int")).over(longs) - F.col("own").cast("int"))
    placed = stored(placed.drop("half", "s_tokens"), "placed")
    spans = placed.groupBy("ck", "cell", "sub").agg(F.min("pos").alias("first"), F.min("start").alias("begin"), F.first("past").alias("past"))
    back = spans.where("first > 0").select("ck", "cell", "sub", "begin", "first", "past", F.explode(F.sequence(F.lit(1), F.lit(max(1, history_turns)))).alias("d"))
    back = back.where(F.col("d") <= history_turns).withColumn("pos", F.col("first") - F.col("d")).where("pos >= 0")
    history = placed.select("conv", "ck", "pos", "role", "text", "start").join(back, ["ck", "pos"]).where(F.col("begin") - F.col("start") <= F.col("past"))
    history = history.join(systems.select("ck").withColumn("pos", F.lit(0).cast("long")), ["ck", "pos"], "left_anti")  # it is repeated anyhow
    later = stored(spans.where("first > 0").select("ck", "cell", "sub"), "later")
    repeated = stored(systems.join(later.groupBy("ck").agg(F.count("*").alias("n")), "ck"), "repeated")
    again = spread_join(later, repeated, "ck").select("ck", "cell", "sub", F.lit(-1).cast("long").alias("pos"), F.col("s_role").alias("role"), F.col("s_text").alias("text"), F.lit(False).alias("new"))
    parts = placed.select("ck", "cell", "sub", "pos", "role", "text", F.lit(True).alias("new"))
    parts = parts.union(history.select("ck", "cell", "sub", "pos", "role", "text", F.lit(False).alias("new"))).union(again)
    head = turn_head(F.col("role"))
    body = escape(F.col("text"))
    parts = parts.select("ck", "cell", "sub", F.struct("pos", "new", head.alias("head"), body.alias("body"), ((F.col("role") == "assistant") & F.col("new")).alias("target")).alias("p"))
    windows = parts.groupBy("ck", "cell", "sub").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    text = F.concat_ws("", F.transform("ps", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))))
    width = F.transform("ps", lambda p: F.struct(F.char_length(p["head"]).alias("h"), F.char_length(p["body"]).alias("b"), p["target"].alias("on")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    loss = F.aggregate(
        width, start,
        lambda s, p: F.struct((s["at"] + p["h"] + p["b"] + len(CLOSE)).alias("at"), F.when(p["on"], F.concat(s["spans"], F.array(F.struct((s["at"] + p["h"]).alias("start"), p["b"].alias("length"))))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"],
    )
    conv_of = F.when(F.col("ck") == "n", F.lit(None)).otherwise(F.substring("ck", 2, 1 << 30)).cast(turns.schema[conv_col].dataType)
    return windows.select(
        conv_of.alias("conv"), F.element_at("ps", -1)["pos"].alias("window"), text.alias("formatted"), loss.alias("loss"),
        F.size(F.filter("ps", lambda p: ~p["new"])).alias("n_context"), F.size(F.filter("ps", lambda p: p["new"])).alias("n_new"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say, from their text, their mask and the counts of their turns: per conversation its turns and the text
    under the loss mask, as digests: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A digest of
    a whole conversation needs its text in one row, so this report (not format_windows) holds a conversation at a time."""
    turns = F.slice(F.split("formatted", F.lit(CLOSE), -1), F.col("n_context") + 1, F.col("n_new"))
    line = F.transform(turns, lambda t: F.concat(F.url_decode(F.substring_index(F.substr(t, F.lit(len(HEAD) + 1)), "\n", 1)), F.lit("\n"), unescape(F.substr(t, F.locate("\n", t) + 1)), F.lit("\n")))
    under = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"])))
    each = windows.select("conv", F.struct("window", F.concat_ws("", line).alias("turns"), F.concat_ws("", under).alias("loss")).alias("w"), "n_new", F.char_length("formatted").cast("long").alias("chars"))
    whole = each.groupBy("conv").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.sum("n_new").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.concat_ws("", F.transform("ws", lambda w: w["loss"]))
    return whole.select(
        "conv", "n_turns", F.sha2(F.concat_ws("", F.transform("ws", lambda w: w["turns"])), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
