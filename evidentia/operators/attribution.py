"""Verification of facts against sources and attribution of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import decision
from ..functions.text import STOP_WORDS, citation_ids, has_citation, numbers, sentences, strip, words
from .postings import supporting
from .storage import saved


#: Facts of one source that are looked for in its text in one row; rows over which facts without a source are dealt; sources of more than
#: TOGETHER facts up to which their numbers of rows are broadcast.
TOGETHER, NOWHERE, FEW = 1000, 1000, 100_000


def verify_facts(facts: DataFrame, sources: DataFrame, model_score: str | None = None, least: float = 0.7) -> DataFrame:
    """facts (source_doc, text, ...) with verified, confidence and method against sources (document_id, source_text); a fact
    whose source is missing stays unverified. model_score: a column with a model's support, used where the local one is below 0.9.

    A source's facts meet its text in one row, TOGETHER of them (more are dealt by hashes over several), so that neither a text nor its
    words are copied to every fact and no word is moved by itself. Of the words of all these facts those that the source lacks are
    found at once; a fact's own are counted against these."""
    width = facts.columns
    mixed = F.xxhash64(*[c for c, kind in facts.dtypes if "map<" not in kind and kind != "variant"])
    named = facts.select(F.col("source_doc").alias("doc"), F.struct(*width).alias("row"), mixed.alias("mixed"))
    heavy = named.where("doc IS NOT NULL").groupBy("doc").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts")).where("parts > 1")
    heavy = saved(heavy, "heavy")
    heavy = F.broadcast(heavy) if heavy.count() <= FEW else heavy
    part = F.pmod("mixed", F.when(F.col("doc").isNull(), F.lit(NOWHERE)).otherwise(F.coalesce("parts", F.lit(1)))).cast("int").alias("part")
    held = named.join(heavy, "doc", "left").groupBy("doc", part).agg(F.collect_list("row").alias("rows"))
    texts = sources.select(F.col("document_id").alias("doc"), F.coalesce("source_text", F.lit("")).alias("whole")).join(heavy, "doc", "left")
    texts = texts.select("doc", "whole", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    text = lambda r: F.coalesce(r["text"], F.lit(""))
    both = held.join(texts, ["doc", "part"], "left").select(F.coalesce("whole", F.lit("")).alias("whole"), F.transform("rows", lambda r: F.struct(r.alias("row"), strip(F.lower(text(r))).alias("fact"))).alias("facts"))
    mine = lambda f: F.array_except(F.array_distinct(words(f["fact"])), F.array(*map(F.lit, STOP_WORDS)))
    cut = F.transform("facts", lambda f: F.struct(f["row"].alias("row"), f["fact"].alias("fact"), mine(f).alias("w"), numbers(text(f["row"])).alias("n")))
    both = both.select("whole", F.lower("whole").alias("low"), cut.alias("facts"))
    lacking = lambda c, there: F.array_except(F.flatten(F.transform("facts", lambda f: f[c])), there)
    both = both.select("whole", "low", "facts", lacking("w", words("low")).alias("no_w"), lacking("n", numbers("whole")).alias("no_n"))
    known = F.col("whole") != ""

    def support(f: Column) -> Column:
        share = lambda c: (F.size(f[c]) - F.size(F.array_intersect(f[c], F.col(f"no_{c}")))) / F.size(f[c])
        part = F.when(F.size(f["n"]) > 0, share("w") * 0.5 + share("n") * 0.5).otherwise(share("w"))
        inside = known & F.contains("low", f["fact"])
        return F.struct(f["row"].alias("row"), known.alias("known"), F.when(inside, 1.0).when(F.size(f["w"]) == 0, 0.0).otherwise(F.least(F.lit(1.0), part)).alias("local"))

    scored = both.select(F.explode(F.transform("facts", support)).alias("f")).select("f.row.*", F.col("f.known").alias("evidentia_known"), F.col("f.local").alias("evidentia_local"))
    v = decision(F.coalesce("text", F.lit("")) == "", ~F.col("evidentia_known"), F.coalesce("evidentia_local", F.lit(0.0)), model_score, least)
    return scored.withColumn("evidentia_v", v).select(*width, *[F.col("evidentia_v")[c].alias(c) for c in ("verified", "confidence", "method")])


def attribute(docs: DataFrame, passages: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, sentence_ord, text, citation_ids, verified, confidence) of every sentence of 5 characters or more.

    A cited sentence keeps its citations and is verified. An uncited one gets, if passages (doc_id, passage_id, text) are
    given, the passage of its document that supports it most, from `least` (above 0) on, ties to the smaller passage_id:
    confidence 0.8; else none: 0. Sentences meet passages on the words of a document, not each with each; equal rows are one,
    rows without a doc_id or passage text find nothing."""
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(text_col)).alias("sentence_ord", "text")).where(F.char_length("text") >= 5)
    cited = cut.where(has_citation("text")).select("*", citation_ids("text").alias("citation_ids"), F.lit(True).alias("verified"), F.lit(None).cast("double").alias("confidence"))
    open_ones = cut.where(~has_citation("text"))
    none = F.array().cast("array<string>")
    if passages is None:
        rest = open_ones.select("*", none.alias("citation_ids"), F.lit(False).alias("verified"), F.lit(0.0).alias("confidence"))
    else:
        key, within = F.struct("doc_id", "sentence_ord", F.md5("text").alias("text")), F.col("doc_id").cast("string").alias("within")
        named = F.struct(F.col("passage_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), F.md5("text").alias("text"))
        facts = open_ones.where("doc_id IS NOT NULL").select(key.alias("item"), within, "text").dropDuplicates(["item"])
        there = passages.where("doc_id IS NOT NULL AND text IS NOT NULL").select(named.alias("source"), within, "text").dropDuplicates(["source"])
        best = supporting(facts, there, 1, fill=False, digits=None).where(F.col("score") >= least)
        best = best.select("item", F.col("source.id").alias("p"))
        rest = open_ones.withColumn("item", key).join(best, "item", "left").select(
            "doc_id", "sentence_ord", "text", F.when(F.col("p").isNull(), none).otherwise(F.array("p")).alias("citation_ids"),
            F.lit(False).alias("verified"), F.when(F.col("p").isNull(), 0.0).otherwise(0.8).alias("confidence"),
        )
    return cited.unionByName(rest)


def citation_coverage(attributed: DataFrame, by: str | None = None) -> DataFrame:
    """sentences, cited, coverage, verified."""
    df = attributed.groupBy(by) if by else attributed
    has = F.size("citation_ids") > 0
    return df.agg(
        F.count("*").alias("sentences"), F.count_if(has).alias("cited"),
        F.round(F.avg(has.cast("double")), 2).alias("coverage"), F.count_if(F.col("verified")).alias("verified"),
    )
