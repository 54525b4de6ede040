"""Reports: index, search, evidence selection, facts, verification, roll-up and the follow-up loop."""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import KEYWORDS, local_support, primary_tag, sufficiency
from ..functions.text import sentences
from ..functions.vectors import dot
from ..operators import attribution, graph, retrieval, selection, tree
from ..operators.storage import saved
from .models import HashEmbedder, lexical_score


def index(docs: DataFrame, embedder=None, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunks with vectors, written once for all searches."""
    embedder = embedder or HashEmbedder()
    return saved(retrieval.chunks(docs, "doc_id", "text", size, overlap).withColumn("embedding", embedder.embed(F.col("text"))), "index")


def search(index: DataFrame, query: str, k: int = 10, embedder=None, section: str | None = None, keywords: dict = KEYWORDS) -> DataFrame:
    """The k best chunks for a query: chunk_id, document_id, text (300 characters), score, tag, rank. With a section, of
    the 2k best those whose header contains it, so maybe fewer than k."""
    spark, embedder = index.sparkSession, embedder or HashEmbedder()
    q = spark.createDataFrame([(query,)], "query string").select(F.lit(0).alias("query_id"), embedder.embed(F.col("query")).alias("q_vec"))
    scored = retrieval.score_all(q, index, measure=lambda a, b: F.round(dot(a, b), 6))
    if section:
        found = retrieval.over_fetch(scored, k, F.contains(F.lower(F.coalesce("section_header", F.lit(""))), F.lit(section.lower())), tie="chunk_id")
    else:
        found = retrieval.top_k(scored, k, tie="chunk_id")
    return found.select("rank", "chunk_id", "document_id", F.substring("text", 1, 300).alias("text"), "score", primary_tag("text", keywords).alias("tag"))


def search_and_judge(index: DataFrame, query: str, decide, k: int = 6, most: int = 2) -> tuple[DataFrame, list[str]]:
    """Search, ask decide(rows) whether that is enough, and search again for what it asks, `most` times at most."""
    asked, found = [query], saved(search(index, query, k), "found")
    for _ in range(most):
        follow = decide(found.orderBy("rank").limit(k).collect())  # at most k rows
        if not follow:
            break
        asked.append(follow)
        found = saved(found.unionByName(search(index, follow, k)).dropDuplicates(["chunk_id"]), "found")
    return found, asked


def extract_facts(chunks: DataFrame, query: str, per_doc: int = 3) -> DataFrame:
    """The default without a model: of each document the sentences that hold most of the query's terms."""
    cut = chunks.select("document_id", "chunk_ord", F.posexplode(sentences("text")).alias("s", "text")).where(F.char_length("text") > 20)
    cut = cut.withColumn("confidence", lexical_score(F.lit(query), F.col("text")))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("confidence"), "chunk_ord", "s"))
    return cut.withColumn("fact_ord", nth).where(F.col("fact_ord") <= per_doc).select("fact_ord", "text", F.col("document_id").alias("source_doc"), "confidence")


@dataclass
class Report:
    session_id: str
    query: str
    evidence: DataFrame
    facts: DataFrame
    passed: bool
    checks: dict
    markdown: str
    rounds: int = 1
    stages: list = field(default_factory=list)


def no_verified_fact(leaves: DataFrame) -> DataFrame:
    """The default critic: a leaf (node_id, verified) without a verified fact lacks one."""
    none = F.array().cast("array<string>")
    return leaves.select("node_id", F.when(F.col("verified") == 0, F.array(F.lit("no verified fact"))).otherwise(none).alias("gaps"))


def leaves_with_gaps(chosen: DataFrame, facts: DataFrame, critic) -> int:
    """How many of the chosen documents, each a leaf of the report, have gaps by critic(leaves)."""
    held = facts.groupBy(F.col("source_doc").alias("paper_id")).agg(F.count_if("verified").alias("verified"))
    leaves = chosen.select("paper_id").distinct().join(held, "paper_id", "left")
    leaves = leaves.select(F.concat(F.lit("d"), F.col("paper_id").cast("string")).alias("node_id"), F.coalesce("verified", F.lit(0)).alias("verified"))
    return critic(leaves).where(F.size("gaps") > 0).count()


def reranked(found: DataFrame, query: str, scorer) -> DataFrame:
    """found in the order of scorer(query, text); earlier ranks first on ties."""
    everything = found.withColumn("query_id", F.lit(0))
    again = retrieval.rerank(everything, scorer(F.lit(query), F.col("text")), (1 << 31) - 1, tie="rank")
    return again.select(F.col("new_rank").alias("rank"), *[c for c in found.columns if c != "rank"])


def full_report(
    index: DataFrame, query: str, target: int = 12, mode: str = "balanced", policy: str = "hybrid_v2", thresholds: dict | None = None,
    keywords: dict = KEYWORDS, rounds: int = 0, more: int = 5, scorer=lexical_score, edges: DataFrame | None = None, critic=no_verified_fact,
) -> Report:
    """Retrieve max(200, 4 target) chunks, re-rank them, choose documents by coverage, add up to `more` documents that the chosen ones
    cite or are cited by in edges (src, dst), take and verify their facts, and judge sufficiency; gaps are the documents
    in which critic finds some. If it fails, `rounds` times add `more` unseen candidates and try again; the last synthesis is returned
    either way. Each stage's table is written; stages that may fail (re-ranking, graph, attribution) are isolated: the report goes
    on without them and its stages name the error."""
    stages, began = [], time.time()
    done = lambda stage, what: stages.append((stage, what, round(time.time() - began, 3)))
    found = saved(search(index, query, max(200, 4 * target), keywords=keywords), "found")
    try:
        found = saved(reranked(found, query, scorer), "reranked") if scorer else found
        done("rerank", None)
    except Exception as error:  # optional
        done("rerank", str(error)[:200])
    ranked = saved(retrieval.candidates(found, keywords), "candidates")
    chosen = saved(selection.select_evidence(ranked, target, mode), "evidence").select("paper_id")
    if edges is not None:
        try:
            chosen = saved(chosen.union(neighbours(index, edges, chosen, more)), "expanded")
            done("graph", None)
        except Exception as error:  # optional
            done("graph", str(error)[:200])
    for turn in range(rounds + 1):
        evidence = index.join(chosen.select(F.col("paper_id").alias("document_id")), "document_id", "left_semi")
        sources = saved(retrieval.source_texts(evidence), "sources")
        facts = saved(attribution.verify_facts(extract_facts(evidence, query).drop("confidence"), sources), "facts")
        gaps = leaves_with_gaps(chosen, facts, critic)
        counts = facts.agg(F.count("*").alias("total"), F.count_if("verified").alias("verified")).withColumn("gaps", F.lit(gaps))
        row = counts.select("*", sufficiency("verified", "total", "gaps", policy, thresholds).alias("s")).first()
        done("round", turn)
        unseen = ranked.join(chosen, "paper_id", "left_anti").orderBy("rank").limit(more)
        if row["s"]["passed"] or turn == rounds or unseen.isEmpty():
            break
        chosen = saved(chosen.union(unseen.select("paper_id")), "evidence")
    try:
        cover = attribution.citation_coverage(attribution.attribute(sources.select(F.col("document_id").alias("doc_id"), F.col("source_text").alias("text")))).first().asDict()
    except Exception as error:  # optional
        cover = {"error": str(error)[:200]}
    checks = {
        "verified_facts": row["verified"], "total_facts": row["total"], "with_gaps": gaps, "reason": row["s"]["reason"], "score": row["s"]["score"], "attribution": cover
    }
    return Report(f"session_{uuid.uuid4().hex}", query, chosen, facts, row["s"]["passed"], checks, markdown(facts, query), turn + 1, stages)


def neighbours(index: DataFrame, edges: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """(paper_id): up to `most` documents of the index, smallest ids first, that chosen ones cite or are cited by."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    near = graph.expand(both, chosen.select(F.col("paper_id").alias("node")), 1, (1 << 31) - 1)
    here = near.join(index.select(F.col("document_id").alias("node")), "node", "left_semi")
    return here.select(F.col("node").alias("paper_id")).orderBy("paper_id").limit(most)


def query_session(index: DataFrame, folder: str, session_id: str, question: str, k: int = 6) -> DataFrame:
    """The k best chunks for a question among the documents that a stored session used as evidence. KeyError without the session."""
    from ..sources.sinks import read_session

    used = read_session(index.sparkSession, folder, session_id).select(F.explode("evidence_papers").alias("used")).distinct()
    own = index.withColumn("used", F.col("document_id").cast("string")).join(used, "used", "left_semi").drop("used")
    return search(own, question, k)


def refine_session(index: DataFrame, folder: str, session_id: str, question: str | None = None, **options) -> Report:
    """A new report on a stored session's query, or on a further question, restricted to its evidence. Write its session_record to go on."""
    from ..sources.sinks import read_session

    session = read_session(index.sparkSession, folder, session_id)
    used = session.select(F.explode("evidence_papers").alias("used")).distinct()
    own = index.withColumn("used", F.col("document_id").cast("string")).join(used, "used", "left_semi").drop("used")
    return full_report(own, question or session.first()["query"], **options)


def markdown(facts: DataFrame, query: str) -> str:
    """Root, one section a source document, its verified facts as the draft: rolled up to one text."""
    drafts = facts.where("verified").groupBy("source_doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("fact_ord", "text"))), lambda f: F.concat(F.lit("- "), f["text"])), "\n").alias("draft"))
    leaves = drafts.select(F.concat(F.lit("d"), F.col("source_doc").cast("string")).alias("node_id"), F.lit("r").alias("parent_id"), F.xxhash64("source_doc").alias("ord"), F.col("source_doc").cast("string").alias("title"), F.lit("").alias("description"), "draft")
    root = facts.sparkSession.createDataFrame([("r", None, 0, query, "", "")], "node_id string, parent_id string, ord long, title string, description string, draft string")
    deep = saved(tree.add_depth(root.unionByName(leaves)), "tree")
    return tree.roll_up(deep).where("node_id = 'r'").first()["draft"]


def session_record(report: Report) -> dict:
    ids = sorted(str(r[0]) for r in report.evidence.collect())  # bounded by the target and the rounds
    return {
        "session_id": report.session_id, "query": report.query, "created_at": time.time(), "evidence_papers": ids,
        "evidence_fingerprint": hashlib.sha256("\n".join(ids).encode()).hexdigest(), "last_sufficiency": report.checks | {"passed": report.passed}, "rounds": report.rounds,
    }


def status(index: DataFrame) -> dict:
    row = index.agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents")).first()
    return row.asDict()


def verify_one(index: DataFrame, fact: str, doc_id: str | None = None, least: float = 0.7) -> dict:
    """A fact against one document, or against the chunk of all that supports it most."""
    scope = index.where(F.col("document_id") == doc_id) if doc_id else index
    best = scope.select("document_id", local_support(F.lit(fact), F.col("text")).alias("confidence")).orderBy(F.desc("confidence"), "document_id").first()
    score = best["confidence"] if best else 0.0
    return {"verified": score >= least, "confidence": score, "source": best["document_id"] if best else None}
