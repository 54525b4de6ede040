"""The best sources of many items through an inverted index: no item is paired with every source.

An item is a set of tokens, words and numbers; a source supports it by the share of its words that the source has, averaged with
the share of its numbers if it has any. An item's tokens are read rarest first. A few of its rarest give sources whose exact
support sets a bar, the k-th best of them; a token is read only while it and the commoner ones together can still reach the bar,
and what is found so is scored exactly only if it can. The bar only rules out what can't be among the k best, so results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, numbers, strip, words
from .retrieval import top_k
from .storage import saved

#: Texts that are looked for in a source in one row.
TOGETHER = 1000
#: Postings an item reads to find its bar, for each of the k; sources it scores for that, for each of the k.
PROBED, TRIED = 50, 4
#: More than support is rounded by.
MARGIN = 2e-6


def tokens(words: Column, numbers: Column) -> Column:
    """Words and numbers as one array, told apart by their first letter."""
    return F.concat(F.transform(words, lambda w: F.concat(F.lit("w"), w)), F.transform(numbers, lambda n: F.concat(F.lit("n"), n)))


def support(n_words, n_numbers, found_words, found_numbers) -> Column:
    """Support by counts: 0 for an item without words."""
    share = F.col(found_words) / F.col(n_words)
    part = F.when(F.col(n_numbers) > 0, share * 0.5 + F.col(found_numbers) / F.col(n_numbers) * 0.5).otherwise(share)
    return F.when(F.col(n_words) == 0, 0.0).otherwise(F.least(F.lit(1.0), part))


def containing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (item, source) of pairs (item, source, looked) whose text (source, low) contains what is looked for. TOGETHER of
    them meet a text in one row, so that it isn't copied to every item."""
    parts = pairs.groupBy("source").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    groups = pairs.join(parts, "source").groupBy("source", F.pmod(F.xxhash64("item"), "parts").alias("part")).agg(F.collect_list(F.struct("item", "looked")).alias("all"))
    return groups.join(texts, "source").select(F.explode(F.filter("all", lambda x: F.contains("low", x["looked"]))["item"]).alias("item"), "source")


def words_with(pieces: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(piece, word) for every distinct piece, not empty, that stands anywhere in a word: they meet on the piece's first three
    characters, or as many as it has, among the runs of one to three characters of a word."""
    key = F.substring("piece", 1, 3)
    run = lambda n: F.when(F.char_length("word") >= n, F.transform(F.sequence(F.lit(1), F.char_length("word") - (n - 1)), lambda i: F.substr("word", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    runs = vocabulary.where("word <> ''").select("word", F.explode(F.array_distinct(F.concat(run(1), run(2), run(3)))).alias("key"))
    asked = pieces.where("piece <> ''").select("piece").distinct().withColumn("key", key)
    return runs.join(asked, "key").where(F.contains("word", F.col("piece"))).select("piece", "word")


def best_sources(items: DataFrame, asked: DataFrame, postings: DataFrame, k: int, sure: DataFrame | None = None, smallest: Sequence = (), digits: int | None = 6) -> DataFrame:
    """(item, source, score, rank): the k best sources of every item, ties to the smaller source.

    items (item, n_words, n_numbers) and asked (item, token, number: boolean) are what is looked for, each token of an item once;
    postings (token, source) what there is, each once. sure (item, source): pairs whose score is 1 whatever their tokens.
    smallest: the 2k smallest sources, with which items that have fewer than k are filled up at score 0; without them they
    stay shorter. Nulls take no part. Written tables between the steps keep lost executors cheap."""
    round_ = lambda c: c if digits is None else F.round(c, digits)
    spread = postings.groupBy("token").agg(F.count("*").alias("df"))
    each = F.when(F.col("number"), 0.5 / F.col("n_numbers")).otherwise(F.when(F.col("n_numbers") > 0, 0.5).otherwise(1.0) / F.col("n_words"))
    rare = Window.partitionBy("item").orderBy("df", "token")
    listed = asked.join(items, "item").where("n_words > 0").join(spread, "token").withColumn("weight", each)
    listed = listed.withColumn("rest", F.sum("weight").over(rare.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    listed = listed.withColumn("read", F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    listed = saved(listed.select("item", "token", "number", "weight", "rest", "read"), "listed")
    held = saved(items.select("item", "n_words", "n_numbers"), "items")

    def exact(pairs: DataFrame) -> DataFrame:
        met = pairs.select("item", "source").join(listed.select("item", "token", "number"), "item").join(postings, ["token", "source"])
        met = met.groupBy("item", "source").agg(F.count_if(~F.col("number")).alias("found_words"), F.count_if("number").alias("found_numbers"))
        return met.join(held, "item").select("item", "source", round_(support("n_words", "n_numbers", "found_words", "found_numbers")).alias("score"))

    first = listed.where(F.col("read") < PROBED * k).join(postings, "token").groupBy("item", "source").agg(F.sum("weight").alias("score"))
    tried = exact(top_k(first, TRIED * k, "item", "source"))
    if sure is not None:
        sure = sure.select("item", "source", F.lit(1.0).alias("score"))
        tried = tried.union(sure).groupBy("item", "source").agg(F.max("score").alias("score"))
    bar = top_k(tried, k, "item", "source").groupBy("item").agg(F.min("score").alias("bar"), F.count("*").alias("n")).where(F.col("n") == k)
    bar = saved(bar.select("item", "bar"), "bars")
    told = listed.join(bar, "item", "left").withColumn("open", F.col("rest") >= F.coalesce("bar", F.lit(0.0)) - MARGIN)
    limits = bar.join(told.where("NOT open").groupBy("item").agg(F.max("rest").alias("unread")), "item")
    some = told.where("open").join(postings, "token").groupBy("item", "source").agg(
        F.sum("weight").alias("part"), F.count_if(~F.col("number")).alias("found_words"), F.count_if("number").alias("found_numbers"))
    some = saved(some.join(limits, "item", "left").where("unread IS NULL OR part + unread >= bar - 2e-6"), "some")
    whole = some.where("unread IS NULL").join(held, "item")
    scored = whole.select("item", "source", round_(support("n_words", "n_numbers", "found_words", "found_numbers")).alias("score"))
    scored = scored.union(exact(some.where("unread IS NOT NULL")))
    if sure is not None:
        scored = scored.union(sure)
    if smallest:
        kind = postings.schema["source"].dataType
        none = F.explode(F.array(*[F.lit(s).cast(kind) for s in smallest])).alias("source")
        scored = scored.union(held.select("item", none).withColumn("score", F.lit(0.0)))
    best = scored.groupBy("item", "source").agg(F.max("score").alias("score"))
    return top_k(best, k, "item", "source")


def fact_parts(facts: DataFrame) -> DataFrame:
    """facts (item, text, ...) with fact, w, n: the text lower-cased and stripped, its distinct words that are no stop words, its
    numbers. A null text is empty."""
    text = F.coalesce("text", F.lit(""))
    parts = facts.withColumns({"fact": strip(F.lower(text)), "n": numbers(text)})
    return parts.withColumn("w", F.array_except(F.array_distinct(words("fact")), F.array(*map(F.lit, STOP_WORDS))))


def supporting(facts: DataFrame, sources: DataFrame, k: int, fill: bool = True, digits: int | None = 6) -> DataFrame:
    """(item, source, score, rank): the k sources (source, text) that support each fact (item, text) most, as local_support
    would: 1 where the text contains the fact, else by words and numbers; ties to the smaller source. Without fill, sources of
    no support are left out. Items and sources are distinct and not null; null texts are empty; an empty fact stands in every text.
    If both tables have a column within (string), a fact is looked for among the sources of the same value alone, and nothing is
    filled up; rows without a value take no part.

    What contains a fact has its inner words, so the rarest of these names the texts to look in. A fact without an inner word that
    counts is looked for by its first word, which ends a word of the text, or is part of one if the fact has no other."""
    at = ["within"] if "within" in facts.columns else []
    facts = saved(fact_parts(facts.select("item", "text", *at)), "facts")
    text = F.coalesce("text", F.lit(""))
    texts = sources.select("source", F.lower(text).alias("low"))
    named = F.concat(*[F.concat(c, F.lit("\0")) for c in at], "token") if at else F.col("token")
    asked = facts.select("item", *at, F.explode(tokens(F.col("w"), F.col("n"))).alias("token"))
    asked = asked.select("item", named.alias("token"), F.startswith("token", F.lit("n")).alias("number")).where("token IS NOT NULL")
    have = sources.select("source", *at, F.explode(tokens(F.array_distinct(words(F.lower(text))), numbers(text))).alias("token"))
    have = have.select("source", named.alias("token"))
    postings = saved(have.join(asked.select("token").distinct(), "token").select("token", "source"), "postings")
    split = words("fact")
    inner = F.array_intersect("w", F.slice(split, F.lit(2), F.greatest(F.size(split) - 2, F.lit(0))))
    some = facts.where("fact <> ''").select("item", *at, "fact", split.alias("all"), inner.alias("inner"))
    spread = postings.groupBy("token").agg(F.count("*").alias("df"))
    held = some.select("item", *at, "fact", F.explode("inner").alias("word")).withColumn("token", F.concat(F.lit("w"), "word"))
    held = held.select("item", "fact", named.alias("token")).join(spread, "token", "left")
    rarest = held.groupBy("item", "fact").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("t"))
    pairs = rarest.select("item", F.col("fact").alias("looked"), F.col("t.token").alias("token")).join(postings, "token").select("item", "source", "looked")
    sure = containing(pairs, texts)
    short = some.where(F.size("inner") == 0).select("item", *at, F.col("fact").alias("looked"), F.get("all", F.lit(0)).alias("piece"))
    if not short.isEmpty():
        every = saved(sources.select("source", *at, F.explode(F.array_distinct(words(F.lower(text)))).alias("word")), "words")
        near = short.join(words_with(short, every.select("word").distinct()), "piece").join(every, ["word", *at])
        sure = sure.union(containing(near.select("item", "source", "looked").distinct(), texts))
    blank = facts.where("fact = ''")
    smallest = []
    if at:
        nth = F.row_number().over(Window.partitionBy("within").orderBy("source"))
        least = sources.select("within", "source").withColumn("nth", nth).where(F.col("nth") <= k)
        sure = sure.union(blank.join(least, "within").select("item", "source"))
    elif fill or not blank.isEmpty():
        smallest = [r[0] for r in sources.select("source").orderBy("source").limit(2 * k).collect()]
        kind = sources.schema["source"].dataType
        anywhere = F.explode(F.array(*[F.lit(s).cast(kind) for s in smallest[:k]])).alias("source")
        sure = sure.union(blank.select("item", anywhere)) if smallest else sure
    items = facts.select("item", F.size("w").alias("n_words"), F.size("n").alias("n_numbers"))
    return best_sources(items, asked, postings, k, saved(sure, "sure"), smallest if fill else (), digits)


def holding(items: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """(item, source, score, rank): the k sources (source, text) that hold the largest share of each item's terms (item,
    terms: distinct runs of a-z and 0-9), anywhere in their lower-cased text; ties to the smaller source, sources that hold none
    fill up. Items and sources are distinct and not null; null texts are empty, null or empty terms have share 0 everywhere.

    A term stands in a text if it stands in one of its runs of letters and digits, so that terms meet the vocabulary, not texts."""
    items = saved(items.select("item", F.coalesce("terms", F.array().cast("array<string>")).alias("terms")), "terms")
    runs = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    every = saved(sources.select("source", F.explode(runs).alias("word")), "words")
    asked = items.select("item", F.explode("terms").alias("token"), F.lit(False).alias("number"))
    named = words_with(asked.select(F.col("token").alias("piece")), every.select("word").distinct())
    postings = saved(every.join(named, "word").select(F.col("piece").alias("token"), "source").distinct(), "postings")
    smallest = [r[0] for r in sources.select("source").orderBy("source").limit(2 * k).collect()]
    return best_sources(items.select("item", F.size("terms").alias("n_words"), F.lit(0).alias("n_numbers")), asked, postings, k, None, smallest, None)
