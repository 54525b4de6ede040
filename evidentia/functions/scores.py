"""Scores and decisions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOP_WORDS, col, numbers, strip, words
from .vectors import let

TAGS = ("T", "E", "M", "A")
#: The default keywords of theory, experiment, method and application.
KEYWORDS = {
    "T": ["theorem", "proof", "lemma", "proposition", "definition", "theory", "framework", "model", "equation", "formula", "bounds", "convergence", "guarantee", "upper bound", "lower bound"],
    "E": ["experiment", "experimental", "evaluation", "benchmark", "dataset", "result", "accuracy", "precision", "recall", "f1", "bleu", "rouge", "throughput", "latency", "ablation", "compared to", "outperforms", "baseline", "metric"],
    "M": ["method", "approach", "algorithm", "architecture", "pipeline", "procedure", "technique", "strategy", "training", "inference", "optimization", "loss function", "encoder", "decoder", "attention", "retrieval", "embedding", "fine-tune"],
    "A": ["application", "deploy", "real-world", "industry", "use case", "system", "product", "service", "case study", "practical", "implementation", "production", "scalability", "cost"],
}


def tag_scores(text, keywords: dict[str, list[str]] = KEYWORDS, closeness: dict[str, Column] | None = None) -> Column:
    """array<struct<tag,score>> in tag order: half a point for each keyword in the text, half the positive closeness to
    a tag's embedding if given, divided by the largest."""
    low = F.lower(col(text))
    raw = [sum((F.contains(low, F.lit(w)).cast("int") for w in keywords[t]), F.lit(0)) * F.lit(0.5) for t in TAGS]
    if closeness:
        raw = [r + F.greatest(F.lit(0.0), closeness[t]) * 0.5 for t, r in zip(TAGS, raw)]
    tags = F.array(*map(F.lit, TAGS))

    def shares(raw: Column) -> Column:
        most = F.array_max(raw)
        return let(F.when(most == 0, F.lit(1.0)).otherwise(most), lambda top: F.transform(raw, lambda r, i: score_of(i, r / top)))

    def score_of(i: Column, share: Column) -> Column:
        return F.struct(F.get(tags, i).alias("tag"), F.round(share, 3).alias("score"))

    return let(F.array(*[r.cast("double") for r in raw]), shares)  # each text is searched once for each keyword


def top_tags(scores, k: int = 2) -> Column:
    """The k best tags; equal scores in tag order."""
    order = F.transform(col(scores), lambda s, i: F.struct((-s["score"]).alias("down"), i.alias("i"), s["tag"].alias("tag"), s["score"].alias("score")))
    return F.slice(F.transform(F.array_sort(order), lambda s: F.struct(s["tag"].alias("tag"), s["score"].alias("score"))), 1, k)


def primary_tag(text, keywords: dict[str, list[str]] = KEYWORDS) -> Column:
    return F.get(top_tags(tag_scores(text, keywords), 1), F.lit(0))["tag"]


def local_support(fact, source, source_low=None, source_words=None, source_numbers=None) -> Column:
    """1 if the source contains the fact; else the share of its words (and, averaged in, numbers) that the source has. The last
    three, if given, are what is derived from the source: for facts that many sources meet."""
    fact, source = col(fact), col(source)
    low = strip(F.lower(fact))
    theirs = col(source_low) if source_low is not None else F.lower(source)
    words_there = col(source_words) if source_words is not None else words(theirs)
    numbers_there = col(source_numbers) if source_numbers is not None else numbers(source)
    mine = F.array_except(F.array_distinct(words(low)), F.array(*map(F.lit, STOP_WORDS)))
    share = F.size(F.array_intersect(mine, words_there)) / F.size(mine)
    figures = numbers(fact)
    figured = F.size(F.array_intersect(figures, numbers_there)) / F.size(figures)
    part = F.when(F.size(figures) > 0, share * 0.5 + figured * 0.5).otherwise(share)
    return F.when(F.contains(theirs, low), F.lit(1.0)).when(F.size(mine) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), part))


def decision(no_fact: Column, no_source: Column, local, model_score=None, least: float = 0.7) -> Column:
    """struct<verified, confidence, method> from a fact's local support; model_score: a model's support where that is below 0.9."""
    model = F.coalesce(col(model_score), F.lit(0.0)) if model_score is not None else F.lit(0.0)
    make = lambda ok, score, how: F.struct(ok.alias("verified"), score.alias("confidence"), how.alias("method"))

    def decide(local: Column) -> Column:
        best = F.greatest(local, model)
        by = F.when(model > local, "llm_semantic").otherwise("local_partial")
        return F.when(local >= 0.9, make(F.lit(True), local, F.lit("local_exact"))).otherwise(make(best >= least, F.round(best, 3), by))

    none = make(F.lit(False), F.lit(0.0), F.lit("none"))
    return F.when(no_fact | no_source, none).otherwise(let(col(local), decide))


def verification(fact, source, model_score=None, least: float = 0.7) -> Column:
    """decision() of a fact against a source in the same row."""
    blank = lambda c: F.coalesce(col(c), F.lit("")) == ""
    return decision(blank(fact), blank(source), local_support(fact, source), model_score, least)


def model_support(confidence, supported) -> Column:
    """A model's answer as a support score: its confidence, 0.3 of it for a claim that it finds unsupported; nothing said is 0."""
    said = F.coalesce(col(confidence).cast("double"), F.lit(0.0))
    return F.when(F.coalesce(col(supported), F.lit(False)), said).otherwise(said * 0.3)


def node_quality(facts, draft_chars, citations) -> Column:
    part = lambda x, most, weight: F.least(col(x) / F.lit(float(most)), F.lit(1.0)) * weight
    return F.when(col(facts) == 0, F.lit(0.2)).otherwise(part(facts, 5, 0.4) + part(draft_chars, 500, 0.3) + part(citations, 3, 0.3))


def paper_relevance(title, abstract, terms: list[str], citations, open_access, has_pdf, source_api) -> Column:
    t, a = F.lower(F.coalesce(col(title), F.lit(""))), F.lower(F.coalesce(col(abstract), F.lit("")))
    hits = sum((F.when(F.contains(t, F.lit(w)), 5.0).otherwise(0.0) + F.when(F.contains(a, F.lit(w)), 1.0).otherwise(0.0) for w in terms), F.lit(0.0))
    flag = lambda c, x: F.when(F.coalesce(col(c), F.lit(False)), x).otherwise(0.0)
    cites = F.least(F.coalesce(col(citations), F.lit(0)) / F.lit(50.0), F.lit(15.0))
    return hits + cites + flag(open_access, 1.0) + flag(has_pdf, 0.5) + F.when(col(source_api) == "arxiv", 0.3).otherwise(0.0)


def sufficiency(verified, total, gaps, mode: str = "hybrid", thresholds: dict | None = None, weights: dict | None = None) -> Column:
    """struct<passed, reason, score>: whether evidence suffices under a mode's gates. The score is for the record only."""
    t = {"min_verified_facts": 8, "min_coverage_sentences": 0.55, "max_gaps": 2, "min_sentence_pool": 12, "min_coverage_proxy": 0.55} | (thresholds or {})
    verified, total, gaps = col(verified), col(total), col(gaps)
    ratio = F.when(total <= 0, F.lit(0.0)).otherwise(verified / total.cast("double"))
    proxy = F.when(gaps <= 0, F.lit(1.0)).otherwise(F.lit(1.0) / (gaps.cast("double") + 1.0))
    count, share, few = verified >= t["min_verified_facts"], ratio >= t["min_coverage_sentences"], gaps <= t["max_gaps"]
    pool, covered = total >= t["min_sentence_pool"], proxy >= t["min_coverage_proxy"]
    fixed = {
        "verified_facts": (count & share & few, "verified_facts_gate"),
        "gap_coverage": (covered & few, "gap_coverage_gate"),
        "llm_judge": (count & share & few, "llm_judge_fallback_hybrid_gate"),
        "hybrid": (count & covered & few, "hybrid_gate"),
    }
    if mode != "hybrid_v2":
        passed, reason = fixed.get(mode, (count & share & few, "unknown_mode_fallback"))
        return F.struct(passed.alias("passed"), F.lit(reason).alias("reason"), F.lit(None).cast("double").alias("score"))
    w = {"w_verified_ratio": 0.45, "w_with_gaps": 0.35, "w_coverage_proxy": 0.20} | (weights or {})
    if sum(w.values()) <= 0:
        w = {"w_verified_ratio": 0.45, "w_with_gaps": 0.35, "w_coverage_proxy": 0.20}
    s = sum(w.values())
    score = F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)) * (w["w_verified_ratio"] / s) + F.lit(1.0) / (gaps.cast("double") + 1.0) * (w["w_with_gaps"] / s) + proxy * (w["w_coverage_proxy"] / s)
    failed = F.array_compact(F.array(
        F.when(~count, F.lit("verified_facts_below_min")), F.when(~share, F.lit("verified_ratio_below_min")),
        F.when(~few, F.lit("with_gaps_exceeds_max")), F.when(~covered, F.lit("coverage_proxy_below_min")),
    ))
    why = F.when(~pool, F.lit("pool_too_small")).when(F.size(failed) > 0, F.array_join(failed, "_")).otherwise("all_gates_passed")
    return F.struct((count & share & few & pool & covered).alias("passed"), F.concat(F.lit("hybrid_v2_gate:"), why).alias("reason"), score.alias("score"))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))
