"""Symbolic reasoning over papers: segments, triples and information units, the relationships that equal triples make between
papers, and papers for the sections of an outline. Every step is a table; models may replace the defaults of single steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import KEYWORDS, tag_scores, top_tags
from ..functions.text import parse_paper_tag, query_terms, sentences
from ..operators import extraction, symbolic
from ..operators.storage import saved


@dataclass
class Reasoning:
    segments: DataFrame
    triples: DataFrame
    info_units: DataFrame
    relationships: DataFrame
    selections: DataFrame
    stats: DataFrame


def segments(papers: DataFrame, keywords: dict = KEYWORDS, text_col: str = "text") -> DataFrame:
    """(paper_id, tag, text): a paper's first sentence of each tag. Without a model a sentence has its best-scored tag, and one
    without any keyword is no segment. A paper without sentences has none."""
    cut = papers.select("paper_id", F.posexplode(sentences(text_col)).alias("nth", "text")).withColumn("s", tag_scores("text", keywords))
    told = cut.where(F.exists("s", lambda t: t["score"] > 0)).withColumn("tag", F.get(top_tags("s", 1), F.lit(0))["tag"])
    return told.groupBy("paper_id", "tag").agg(F.min_by("text", "nth").alias("text"))


def shared_triples(segments: DataFrame, triples: DataFrame) -> DataFrame:
    """The default relationships: a paper supports every other paper that states one of its triples, whatever the case. Of the papers
    that state a triple, the smallest is joined with each other one, so a triple of many papers gives as many rows and
    not all their pairs. Each paper stands for its first tag. Returns from_ref and to_ref ('[paper]tag'), relation, explanation and
    evidence (keys of the triples)."""
    tags = segments.groupBy("paper_id").agg(F.min("tag").alias("tag"))
    keyed = triples.select("paper_id", symbolic.triple_key("subject", "predicate", "object").alias("key")).distinct()
    first = keyed.groupBy("key").agg(F.min("paper_id").alias("hub"))
    pairs = keyed.join(first, "key").where("hub <> paper_id").groupBy("hub", "paper_id").agg(F.sort_array(F.collect_set("key")).alias("evidence"))
    ref = lambda paper, tag: F.concat(F.lit("["), F.col(paper).cast("string"), F.lit("]"), tag)
    whole = pairs.join(tags.select(F.col("paper_id").alias("hub"), F.col("tag").alias("hub_tag")), "hub").join(tags, "paper_id")
    return whole.select(
        ref("hub", "hub_tag").alias("from_ref"), ref("paper_id", "tag").alias("to_ref"), F.lit("supports").alias("relation"), F.lit("").alias("explanation"), "evidence"
    )


def relationships(answers: DataFrame, triples: DataFrame) -> DataFrame:
    """answers (from_ref, to_ref, relation, explanation, evidence) as relationships: references parsed into paper and tag (M where they
    have no such form), an absent relation is supports, and evidence keeps the keys, lower-cased, that some triple has. Answers
    that are equal, evidence included, are one."""
    given = answers.select("from_ref", "to_ref", "relation", "explanation", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence")).distinct()
    parts = ["from_ref", "to_ref", "relation", "explanation"]
    given = given.withColumn("row", F.sha2(F.to_json(F.struct(*parts, "evidence"), {"ignoreNullFields": "false"}), 256))
    known = triples.select(symbolic.triple_key("subject", "predicate", "object").alias("key")).distinct()
    held = given.select("row", F.explode(F.transform("evidence", lambda e: F.lower(e))).alias("key")).join(known, "key")
    held = held.groupBy("row").agg(F.sort_array(F.collect_set("key")).alias("held"))
    a, b = parse_paper_tag(F.coalesce("from_ref", F.lit(""))), parse_paper_tag(F.coalesce("to_ref", F.lit("")))
    return given.join(held, "row", "left").select(
        a["paper"].alias("from_paper"), a["tag"].alias("from_tag"), b["paper"].alias("to_paper"), b["tag"].alias("to_tag"),
        F.coalesce("relation", F.lit("supports")).alias("relation"), F.coalesce("explanation", F.lit("")).alias("explanation"),
        F.coalesce("held", F.array().cast("array<string>")).alias("evidence"),
    )


def select_papers(sections: DataFrame, papers: DataFrame, top_k: int = 5, text_col: str = "text") -> DataFrame:
    """(section_id, paper_id, score, rank): the top_k papers of each section (section_id, title), by the share of the title's terms that
    are words of the paper; ties to the smaller paper. Sections and papers meet on their words, so papers without any
    of a section's words are no candidates and no section is paired with every paper."""
    asked = sections.select("section_id", query_terms("title").alias("terms")).where(F.size("terms") > 0)
    asked = asked.select("section_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    have = papers.select("paper_id", F.explode(query_terms(text_col)).alias("term"))
    shared = have.join(asked, "term").groupBy("section_id", "paper_id").agg((F.count("*") / F.max("n")).alias("score"))
    order = Window.partitionBy("section_id").orderBy(F.desc("score"), "paper_id")
    return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def statistics(papers: DataFrame, segments: DataFrame, triples: DataFrame, info_units: DataFrame, relationships: DataFrame, sections: DataFrame) -> DataFrame:
    """One row of counts; a triple is fully resolved from completeness 2 on. Each is an aggregate of its own table."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    full = triples.agg(F.count("*").alias("total_triples"), F.count_if(F.col("completeness") >= 2).alias("fully_resolved_triples"))
    tables = (n(segments, "total_segments"), full, n(info_units, "total_info_units"), n(relationships, "relationships"), n(sections, "sections"))
    row = n(papers, "papers")
    for other in tables:
        row = row.crossJoin(other)  # one row each
    return row


def reason(
    papers: DataFrame, triples: DataFrame | None = None, info_units: DataFrame | None = None, terms: DataFrame | None = None, sections: DataFrame | None = None, top_k: int = 5,
    relate: Callable[[DataFrame, DataFrame], DataFrame] = shared_triples, segment: Callable[[DataFrame], DataFrame] = segments, verbs: str | None = None,
) -> Reasoning:
    """All steps over papers (paper_id, text): segments; triples with all three parts, resolved across sentences by terms (paper_id,
    sentence_idx, term); relationships from relate(segments, triples), none with fewer than two segments; the top_k papers
    of each section (section_id, title); counts. Tables that later steps share are written once.

    What isn't given is taken from the texts (operators.extraction): triples by a chunker, whose predicates are the words that match
    `verbs`; information units with key phrases; terms from the units' phrases. No sections: none are served."""
    spark = papers.sparkSession
    if triples is None:
        triples = extraction.extract_triples(papers, "paper_id", verbs=verbs).withColumn("triple_id", F.monotonically_increasing_id())
        triples = saved(triples, "extracted")  # fixes the ids
    if info_units is None:
        info_units = saved(extraction.info_units(papers, "paper_id"), "units")
    if terms is None:
        named = {"predicates", "entities"} <= set(info_units.columns)
        terms = extraction.unit_terms(info_units) if named else papers.limit(0).select("paper_id", F.lit(0).alias("sentence_idx"), F.lit("").alias("term"))
    sections = spark.createDataFrame([], "section_id int, title string") if sections is None else sections
    cut = saved(segment(papers), "segments")
    resolved = saved(symbolic.resolve_triples(symbolic.valid_triples(triples), terms), "triples")
    answers = relate(cut, resolved)
    if cut.limit(2).count() < 2:
        answers = answers.limit(0)
    related = saved(relationships(answers, resolved), "relationships")
    chosen = select_papers(sections, papers, top_k)
    return Reasoning(cut, resolved, info_units, related, chosen, statistics(papers, cut, resolved, info_units, related, sections))
