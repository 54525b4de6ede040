"""Synthesis of a report from given evidence: outline, leaves, tree, statistics and the result's files."""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators import extraction, tree
from ..operators.storage import saved
from . import leaves as leaf_plan
from .models import lexical_score


@dataclass
class Synthesis:
    query: str
    outline: DataFrame
    facts: DataFrame
    markdown: str
    tree: dict
    stats: dict

    def as_dict(self) -> dict:
        return {"query": self.query, "final_text": self.markdown, "tree": self.tree, "stats": self.stats}


def phrase_outline(evidence: DataFrame, query: str, most: int = 5) -> DataFrame:
    """The default outline without a model: a root, the query, and as sections the key phrases of two words or more that most evidence
    documents share, ties by phrase. Evidence without any has the query itself as its one section."""
    cut = evidence.select(F.col("document_id").alias("doc_id"), "chunk_ord", F.posexplode(sentences("text")).alias("s", "text"))
    cut = cut.select("doc_id", F.xxhash64("chunk_ord", "s").alias("sentence_idx"), "text")
    told = extraction.key_phrases(cut).select("doc_id", F.explode("key_phrases").alias("phrase")).where(F.contains("phrase", F.lit(" ")))
    ranked = told.groupBy("phrase").agg(F.countDistinct("doc_id").alias("docs")).orderBy(F.desc("docs"), "phrase").limit(most)
    titles = [r["phrase"] for r in ranked.collect()]  # at most `most`
    return tree.build_outline(evidence.sparkSession, query, [{"title": t, "percent": 100 / max(1, len(titles))} for t in titles or [query]])


def report_statistics(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total_facts, verified_facts, verification_rate ('3/4 = 75%') and mean_confidence to two places of facts (verified, confidence): one
    row, or one for each group. Null verified counts as not verified; without facts the rate is '0/0 = 0%'."""
    grouped = facts.groupBy(*by) if by else facts.groupBy()
    row = grouped.agg(
        F.count("*").alias("total_facts"), F.count_if(F.coalesce("verified", F.lit(False))).alias("verified_facts"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 2).alias("mean_confidence"),
    )
    percent = F.round(F.col("verified_facts") / F.greatest(F.col("total_facts"), F.lit(1)) * 100).cast("long")
    rate = F.concat(F.col("verified_facts").cast("string"), F.lit("/"), F.col("total_facts").cast("string"), F.lit(" = "), percent.cast("string"), F.lit("%"))
    return row.select(*(by or []), "total_facts", "verified_facts", rate.alias("verification_rate"), "mean_confidence")


def synthesize(
    index: DataFrame, query: str, doc_ids: DataFrame | None = None, sections: list[dict] | None = None, most_sections: int = 5, k: int = 8,
    critic: Callable[[DataFrame], DataFrame] | None = None, max_depth: int = 2, penalty: float = 0.8, scorer=lexical_score,
) -> Synthesis:
    """A report on query from the evidence documents doc_ids (document_id) alone, or from the whole index.

    The outline is `sections` (title, description, keywords, percent) or phrase_outline's; critic(leaves), if given, grows it where it
    finds gaps. All leaves are processed in one chain (leaves.process_leaves), on the restricted index, so facts, drafts and verification see nothing
    else; facts that repeat across sections lose confidence; drafts are rolled up and compiled. Leaves without a verified fact
    count as having gaps. LookupError if no chunk belongs to the evidence.

    Only the report, its counts and the outline's few titles reach the driver."""
    began, spark = time.time(), index.sparkSession
    own = index if doc_ids is None else saved(index.join(doc_ids.select("document_id").distinct(), "document_id", "left_semi"), "restricted")
    if own.isEmpty():
        raise LookupError("no chunks belong to the evidence")
    outline = phrase_outline(own, query, most_sections) if sections is None else tree.build_outline(spark, query, sections)
    if critic is not None:
        outline = tree.expand_gaps(outline, critic, max_depth)
    deep = saved(tree.bfs_order(tree.add_depth(outline)), "outline")
    done = leaf_plan.process_leaves(deep.where("is_leaf").select("node_id", "title", "keywords"), own, k, scorer=scorer)
    facts = done.facts.join(deep.select("node_id", "bfs"), "node_id")
    facts = saved(tree.duplicate_penalty(facts, penalty), "facts")
    verified = facts.groupBy("node_id").agg(F.count_if("verified").alias("verified"))
    told = done.nodes.select("node_id", "draft", "confidence", "is_complete").join(verified, "node_id", "left")
    none = F.array().cast("array<string>")
    gaps = F.when(F.coalesce("verified", F.lit(0)) == 0, F.array(F.lit("no verified fact"))).otherwise(none).alias("gaps")
    told = told.select("node_id", "draft", "confidence", "is_complete", gaps)
    deep = saved(deep.drop("draft", "confidence", "is_complete", "gaps").join(told, "node_id", "left"), "drafted")
    text = tree.compile_report(deep, tree.roll_up(deep), facts).first()["report"]
    shape = tree.tree_stats(deep).first().asDict()
    counts = report_statistics(facts).first().asDict()
    n_sections = deep.where("depth = 1").count()
    about = {"sections": n_sections, "leaves": shape["leaves"], "max_depth": shape["max_depth"], "with_gaps": shape["with_gaps"], "avg_confidence": shape["avg_confidence"]}
    stats = {
        "total_time_sec": round(time.time() - began, 1), "total_sections": n_sections, "total_leaves": shape["leaves"], "total_facts": counts["total_facts"],
        "verified_facts": counts["verified_facts"], "verification_rate": counts["verification_rate"], "avg_confidence": shape["avg_confidence"],
        "with_gaps": shape["with_gaps"], "max_depth": shape["max_depth"],
    }
    return Synthesis(query, deep, facts, text, about, stats)


def _replace(path: str, text: str) -> str:
    """Write a file in one step: a reader sees the old one or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    Path(folder).mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, suffix=".tmp", delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)
    return path


def write_result(result: Synthesis, path: str) -> str:
    """The result as JSON, or, for a path that ends in .md, the report alone."""
    return _replace(path, result.markdown if path.endswith(".md") else json.dumps(result.as_dict(), ensure_ascii=False, indent=2))


def write_sections(index: DataFrame, queries: list[str], path: str, **options) -> list[dict]:
    """One report a query, one after another; after each the file at path holds all those so far (query, text, stats), so an interrupted
    run loses only the one it was at, and what the file already holds is not done again. A query without evidence is noted with its error."""
    try:
        held = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        held = []
    for query in queries:
        if any(x["query"] == query and "text" in x for x in held):
            continue
        held = [x for x in held if x["query"] != query]
        try:
            done = synthesize(index, query, **options)
            held.append({"query": query, "text": done.markdown, "stats": done.stats})
        except LookupError as error:
            held.append({"query": query, "error": str(error)})
        _replace(path, json.dumps(held, ensure_ascii=False, indent=2))
    return held
