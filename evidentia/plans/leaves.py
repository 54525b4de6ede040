"""The leaves of an outline, all at once: one query table through retrieval, facts, verification and drafts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import node_quality
from ..functions.text import col, query_terms, sentences, words
from ..functions.vectors import let
from ..operators import attribution, retrieval
from ..operators.storage import saved
from .models import HashEmbedder, lexical_score

#: What a section without facts says.
NO_FACTS = "[No relevant facts found for this section.]"


@dataclass
class Leaves:
    evidence: DataFrame
    facts: DataFrame
    nodes: DataFrame


def leaf_queries(leaves: DataFrame, embedder=None) -> DataFrame:
    """(node_id, title, query, q_vec): a leaf asks for its keywords, or without any for its title."""
    embedder = embedder or HashEmbedder()
    keywords = F.coalesce("keywords", F.array().cast("array<string>")) if "keywords" in leaves.columns else F.array().cast("array<string>")
    asked = F.when(F.size(keywords) > 0, F.array_join(keywords, " ")).otherwise(F.coalesce("title", F.lit("")))
    return leaves.select("node_id", F.coalesce("title", F.lit("")).alias("title"), asked.alias("query")).withColumn("q_vec", embedder.embed(F.col("query")))


def leaf_evidence(queries: DataFrame, index: DataFrame, k: int = 8, over: int = 2, scorer=lexical_score, tie: str = "chunk_id") -> DataFrame:
    """(node_id, title, query, document_id, chunk_ord, text, rank): the k best chunks of each leaf by vector, or, with a scorer, the
    k that it puts first among the `over` times k best, earlier ones first on ties; equal vectors in the order of `tie`. All leaves meet the
    index by blocks of vectors (retrieval.nearest); texts, told apart by a digest where ids repeat, are joined with what is found."""
    slim = queries.select(F.col("node_id").alias("query_id"), "q_vec")
    named = index.withColumn("chunk", F.struct("document_id", "chunk_ord", F.md5(F.col("text").cast("binary")).alias("digest")))
    found = retrieval.nearest(slim, named, over * k if scorer else k, tie, ["chunk"])
    found = saved(found.select(F.col("query_id").alias("node_id"), "chunk", "rank"), "found")
    texts = retrieval.among(named.select("chunk", "text"), found, "chunk").dropDuplicates(["chunk"])
    found = found.join(texts, "chunk").select("node_id", "chunk.document_id", "chunk.chunk_ord", "text", "rank")
    found = found.join(queries.drop("q_vec"), "node_id")
    if not scorer:
        return found
    again = retrieval.rerank(found, scorer(F.col("query"), F.col("text")), k, "node_id")
    return again.drop("rank", "rerank_score").withColumnRenamed("new_rank", "rank")


def leaf_facts(evidence: DataFrame, per_leaf: int = 12, shortest: int = 20) -> DataFrame:
    """(node_id, fact_ord, text, source_doc, score): of each leaf the per_leaf sentences of its chunks, longer than `shortest`, that
    hold most of its query's terms, none without any; earlier chunks, then sentences, first on ties. A sentence that
    several chunks of a document show is one fact."""
    asked = evidence.withColumn("terms", query_terms("query"))
    cut = asked.select("node_id", "terms", F.col("document_id").alias("source_doc"), "rank", F.posexplode(sentences("text")).alias("s", "text"))
    cut = cut.where(F.char_length("text") > shortest).withColumn("score", F.round(lexical_score(F.lit(""), F.col("text"), F.col("terms")), 9)).where("score > 0")
    once = cut.groupBy("node_id", "source_doc", "text").agg(F.min(F.struct("rank", "s")).alias("at"), F.first("score").alias("score"))
    order = Window.partitionBy("node_id").orderBy(F.desc("score"), "at", "source_doc", "text")
    facts = once.withColumn("fact_ord", F.row_number().over(order)).where(F.col("fact_ord") <= per_leaf)
    return facts.select("node_id", "fact_ord", "text", "source_doc", "score")


def chosen_facts(facts, most: int = 6, penalty: float = 0.5) -> Column:
    """array<int>: of array<struct<ord, score, words>> the ords of up to `most` facts, by greedy selection: each time the one of the highest
    score less `penalty` times its largest Jaccard similarity to a chosen one (to 9 places; ties: the smaller ord)."""
    value = lambda f: F.round(f["score"] - penalty * f["near"], 9)
    near = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))
    fact = lambda f, n: F.struct(f["ord"].alias("ord"), f["score"].alias("score"), f["words"].alias("words"), n.alias("near"))

    def step(s: Column, _: Column) -> Column:
        best = F.array_max(F.transform(s["rest"], lambda f: F.struct(value(f).alias("value"), (-f["ord"]).alias("down"), f["words"].alias("words"))))

        def take(b: Column) -> Column:
            rest = F.filter(s["rest"], lambda f: f["ord"] != -b["down"])
            rest = F.transform(rest, lambda f: fact(f, F.greatest(f["near"], near(f["words"], b["words"]))))
            return F.struct(F.concat(s["chosen"], F.array(-b["down"])).alias("chosen"), rest.alias("rest"))

        return F.when(F.size(s["rest"]) > 0, let(best, take)).otherwise(s)

    start = F.struct(F.array().cast("array<int>").alias("chosen"), F.transform(col(facts), lambda f: fact(f, F.lit(0.0))).alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["chosen"])


def draft_leaves(leaves: DataFrame, facts: DataFrame, most: int = 6, penalty: float = 0.5) -> DataFrame:
    """(node_id, title, draft, n_facts, n_citations, chosen) of every leaf: the default draft without a model quotes the chosen facts (chosen_facts), each
    with its source in brackets, under the title. A leaf's facts are as few as leaf_facts leaves, so they are one array and
    all leaves draft in one pass, without a round trip for each choice. Without facts it says so."""
    row = F.struct(F.col("fact_ord").alias("ord"), "score", F.array_distinct(words(F.lower("text"))).alias("words"), "text", F.col("source_doc").cast("string").alias("source"))
    held = facts.groupBy("node_id").agg(F.sort_array(F.collect_list(row)).alias("facts"))
    slim = F.transform("facts", lambda f: F.struct(f["ord"].alias("ord"), f["score"].alias("score"), f["words"].alias("words")))
    told = held.withColumn("chosen", chosen_facts(slim, most, penalty))
    quote = lambda i: F.get(F.transform(F.filter("facts", lambda f: f["ord"] == i), lambda f: F.concat(f["text"], F.lit(" ["), f["source"], F.lit("]"))), F.lit(0))
    sources = F.filter(F.array_distinct(F.transform("facts", lambda f: f["source"])), lambda s: F.coalesce(s, F.lit("")) != "")
    told = told.select("node_id", F.array_join(F.transform("chosen", quote), " ").alias("body"), F.size("facts").alias("n_facts"), F.size(sources).alias("n_citations"), "chosen")
    whole = leaves.select("node_id", F.coalesce("title", F.lit("")).alias("title")).join(told, "node_id", "left")
    draft = F.concat(F.lit("## "), "title", F.lit("\n\n"), F.coalesce("body", F.lit(NO_FACTS)))
    none = F.array().cast("array<int>")
    return whole.select(
        "node_id", "title", draft.alias("draft"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_citations", F.lit(0)).alias("n_citations"),
        F.coalesce("chosen", none).alias("chosen"),
    )


def process_leaves(
    leaves: DataFrame, index: DataFrame, k: int = 8, per_leaf: int = 12, most: int = 6, penalty: float = 0.5, embedder=None, scorer=lexical_score, least: float = 0.7,
    tie: str = "chunk_id",
) -> Leaves:
    """Search, re-rank, extract, verify, draft and evaluate every leaf (node_id, title, keywords) of an outline.

    All leaves go through one chain of jobs as rows of a query table; nothing is looped over on the driver. nodes: draft_leaves'
    columns with confidence (node_quality) and is_complete. facts: leaf_facts' with verified, confidence and method against
    the whole source. Leaves whose query finds nothing have no facts, the stated draft and the least confidence. No leaves: no rows."""
    queries = saved(leaf_queries(leaves, embedder), "leaf_queries")
    evidence = saved(leaf_evidence(queries, index, k, scorer=scorer, tie=tie), "leaf_evidence")
    found = saved(leaf_facts(evidence, per_leaf), "leaf_facts")
    used = retrieval.among(index.select("document_id", "chunk_ord", "text"), found.select(F.col("source_doc").alias("document_id")), "document_id")
    facts = saved(attribution.verify_facts(found, retrieval.source_texts(used, (1 << 31) - 1), least=least), "facts")
    drafted = draft_leaves(leaves, facts, most, penalty)
    quality = node_quality("n_facts", F.char_length("draft"), "n_citations")
    return Leaves(evidence, facts, saved(drafted.withColumn("confidence", quality).withColumn("is_complete", F.lit(True)), "leaves"))
