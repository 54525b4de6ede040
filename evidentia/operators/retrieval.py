"""Exact vector retrieval, re-ranking and candidates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import KEYWORDS, primary_tag
from ..functions.vectors import cosine, dot

#: Queries and rows of a block of the exact search; scores that are held at once; keys up to which a table is narrowed by a broadcast.
QUERIES, ROWS, CELLS, FEW = 16384, 32768, 1 << 22, 100_000


def chunks(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", size: int = 1000, overlap: int = 100) -> DataFrame:
    """document_id, chunk_ord, chunk_id, text, start_pos, end_pos: the windows of every text; blank ones are left out and
    don't count. Per-row expressions only: nothing is shuffled."""
    from ..functions.text import chunk_spans, strip

    cut = docs.select(F.col(doc_col).alias("document_id"), F.col(text_col).alias("whole"), chunk_spans(text_col, size, overlap).alias("spans"))
    made = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), strip(F.substr("whole", s["start"] + 1, s["end"] - s["start"])).alias("text")))
    cut = cut.select("document_id", F.posexplode(F.filter(made, lambda c: c["text"] != "")).alias("chunk_ord", "c"))
    return cut.select(
        "document_id", "chunk_ord", F.concat(F.col("document_id").cast("string"), F.lit("_chunk_"), F.col("chunk_ord").cast("string")).alias("chunk_id"),
        F.col("c.text").alias("text"), F.col("c.start").alias("start_pos"), F.col("c.end").alias("end_pos"),
    )


def score_all(queries: DataFrame, chunks: DataFrame, q_vec: str = "q_vec", c_vec: str = "embedding", measure: Callable = dot, most_queries: int = 10_000) -> DataFrame:
    """Every chunk against every query: exact search. The query set must be small; a count checks that."""
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries; search them in parts")
    return chunks.join(F.broadcast(queries)).withColumn("score", measure(q_vec, c_vec))


def top_k(scored: DataFrame, k: int, query_col: str = "query_id", tie: str = "chunk_ord", score: str = "score") -> DataFrame:
    """The k best rows of each query, ties to the smaller `tie`; rank from 1. Spark limits each task's rows before it shuffles."""
    order = Window.partitionBy(query_col).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Vectors:
    """A block's vectors by their lengths."""

    def __init__(self, table: pa.Table):
        lists = table["v"].combine_chunks()
        self.sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
        self.values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.starts = np.concatenate([[0], np.cumsum(np.maximum(self.sizes, 0))[:-1]]) if len(self.sizes) else np.zeros(0, np.int64)

    def of_size(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vectors of that length, and the vectors."""
        at = np.flatnonzero(self.sizes == size)
        return at, self.values[self.starts[at][:, None] + np.arange(size)[None]]


def _summed(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed from the first component on, as functions.vectors.dot does."""
    total = np.zeros(len(q))
    with np.errstate(all="ignore"):  # infinite components
        for d in range(q.shape[1]):
            total += q[:, d] * x[:, d]
    return total


def _block_best(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (place in q, place in x) and their scores among which are the k best of each q once scores are rounded; x is in the order of ties,
    places own[i, 0] to own[i, 1] don't count for q[i]. A matrix product, exact to a margin, says which pairs are summed in order."""
    plain_q, plain_x = np.isfinite(q).all(1), np.isfinite(x).all(1)
    some, rest = np.flatnonzero(plain_x), np.flatnonzero(~plain_x)
    size = np.sqrt((x[some] * x[some]).sum(1)).max(initial=0.0)
    qs, xs = [], []
    for first in range(0, len(q), step := max(1, CELLS // max(1, len(x)))):
        part = np.arange(first, min(len(q), first + step))
        fast = part[plain_q[part]]
        if len(fast) and len(some):
            near = q[fast] @ x[some].T
            for i in np.flatnonzero(own[fast, 1] > own[fast, 0]):
                near[i, np.searchsorted(some, own[fast[i], 0]) : np.searchsorted(some, own[fast[i], 1])] = -np.inf
            margin = slack + 4e-16 * (q.shape[1] + 2) * np.sqrt((q[fast] * q[fast]).sum(1)) * size
            bar = np.partition(near, len(some) - k, axis=1)[:, len(some) - k] - margin if len(some) > k else np.full(len(fast), -np.inf)
            a, b = np.nonzero(near >= bar[:, None])
            qs.append(fast[a]), xs.append(some[b])
        for these, those in ((fast, rest), (part[~plain_q[part]], np.arange(len(x)))):
            qs.append(np.repeat(these, len(those))), xs.append(np.tile(those, len(these)))
    a, b = np.concatenate(qs or [np.zeros(0, np.int64)]), np.concatenate(xs or [np.zeros(0, np.int64)])
    there = (b < own[a, 0]) | (b >= own[a, 1])
    a, b = a[there], b[there]
    score = np.concatenate([_summed(q[a[i : i + CELLS // 16]], x[b[i : i + CELLS // 16]]) for i in range(0, len(a), CELLS // 16)] or [np.zeros(0)])
    order = np.lexsort((b, -score, a))
    a, b, score = a[order], b[order], score[order]
    same = (a[1:] == a[:-1]) & ((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1])))
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1]) if len(a) else np.zeros(0, np.int64)
    nth = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) if len(a) else starts
    kept = nth < k  # of equal scores the first k
    return a[kept], b[kept], score[kept]


def _meet(k: int, slack: float, itself: bool, schema: pa.Schema):
    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return schema.empty_table()
        held = held.take(pc.sort_indices(held, sort_keys=[("tie", "ascending")], null_placement="at_start"))
        own = np.zeros((len(asked), 2), np.int64)
        if not itself:
            ids = pa.concat_arrays([held["tie"].combine_chunks(), asked["query_id"].combine_chunks().cast(held["tie"].type)]).dictionary_encode().indices.to_numpy()
            codes, mine = ids[: len(held)], ids[len(held) :]  # equal ids of held are neighbours, numbered as they come
            own = np.stack([np.searchsorted(codes, mine, "left"), np.searchsorted(codes, mine, "right")], 1)
        queries, rows = _Vectors(asked), _Vectors(held)
        at_q, at_r, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.float64())]
        for size in np.unique(queries.sizes):
            if size < 0:
                which, there = np.flatnonzero(queries.sizes < 0), np.zeros(0, np.int64)
            else:
                (which, q), (there, x) = queries.of_size(size), rows.of_size(size)
                inside = np.searchsorted(there, own[which])
                a, b, score = _block_best(q, x, inside, k, slack)
                at_q.append(which[a]), at_r.append(there[b]), scores.append(pa.array(score))
            if len(there) <= k + 1 or not itself:  # few scores: rows without one follow, the first by tie
                others = np.setdiff1d(np.arange(len(held)), there)
                for i in which:
                    left = k - len(there) + np.count_nonzero((there >= own[i, 0]) & (there < own[i, 1]))
                    if left > 0:
                        fill = others[(others < own[i, 0]) | (others >= own[i, 1])][:left]
                        at_q.append(np.full(len(fill), i)), at_r.append(fill), scores.append(pa.nulls(len(fill), pa.float64()))
        found = held.take(pa.array(np.concatenate(at_r)))
        columns = [asked["query_id"].take(pa.array(np.concatenate(at_q))), found["row"], found["tie"], pa.concat_arrays(scores)]
        return pa.table(dict(zip(schema.names, columns)))

    return best


def nearest(queries: DataFrame, rows: DataFrame, k: int, tie: str = "chunk_ord", carry: Sequence[str] = (), itself: bool = True, q_vec: str = "q_vec", c_vec: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, carry, tie, score, rank): the k rows of each query of the largest inner product, rounded to `digits`, ties to the smaller `tie`: what
    top_k finds among score_all, for any number of queries. itself: whether a row whose tie is the query's id counts.

    Blocks of about QUERIES queries meet blocks of about ROWS rows, dealt by hashes, so a task holds one of each, and pairs of queries and
    rows exist only there, CELLS at once; a block passes on the k best of each query (and what rounding could put among them). Nothing but ids,
    `carry` and vectors is moved, so texts are to be joined with what is found. Vectors without a score (null, null components, another length
    than the query's) come last, as nulls do."""
    from pyspark.sql.pandas.types import to_arrow_schema

    clean = lambda v: F.when(~F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(False)), F.col(v)).alias("v")
    blocks, groups = max(1, -(-rows.count() // ROWS)), max(1, -(-queries.count() // QUERIES))
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt = lambda c, n: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    asked = queries.select("query_id", clean(q_vec))
    held = rows.select(F.struct(F.lit(0).alias("evidentia"), *[F.col(c) for c in carry]).alias("row"), F.col(tie).alias("tie"), clean(c_vec))
    if not itself:
        asked, held = asked.where("query_id IS NOT NULL"), held.where("tie IS NOT NULL")
    asked = asked.select("*", dealt(["query_id"], groups).alias("group"), every("block", blocks))
    held = held.select("*", dealt(["tie", "row"], blocks).alias("block"), every("group", groups))
    width = min(2000, 3 * blocks * groups)
    asked, held = (d.repartition(width, "group", "block").groupBy("group", "block") for d in (asked, held))
    out = queries.select("query_id").schema.add("row", rows.select(F.struct(F.lit(0).alias("evidentia"), *[F.col(c) for c in carry]).alias("row")).schema["row"].dataType)
    out = out.add("tie", rows.schema[tie].dataType).add("score", "double")
    best = _meet(k, 1.01 * 10.0**-digits, itself, to_arrow_schema(out))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return best(a, b)

    found = asked.cogroup(held).applyInArrow(meet, out).withColumn("score", F.round("score", digits))
    ranked = top_k(found, k, tie="tie")
    return ranked.select("query_id", *[F.col(f"row.{c}").alias(c) for c in carry], *([] if tie in carry else [F.col("tie").alias(tie)]), "score", "rank")


def among(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose `on` is among keys' (a table that was written). Few keys are broadcast, so that rows aren't shuffled for them."""
    keys = keys.select(on).distinct()
    return rows.join(F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys, on, "left_semi")


def over_fetch(scored: DataFrame, k: int, keep: Column, query_col: str = "query_id", tie: str = "chunk_ord") -> DataFrame:
    """The first k of the 2k best that satisfy keep: may be fewer than k, the filter comes after the fetch."""
    return ranked_again(top_k(scored, 2 * k, query_col, tie).where(keep), k, query_col)


def ranked_again(kept: DataFrame, k: int, query_col: str = "query_id") -> DataFrame:
    """The first k of what a filter left of ranked rows, ranked from 1."""
    again = Window.partitionBy(query_col).orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def rerank(found: DataFrame, scorer: Column, top_n: int, query_col: str = "query_id", tie: str = "rank") -> DataFrame:
    """Order a query's rows by a model's score, earlier ones first on ties."""
    order = Window.partitionBy(query_col).orderBy(F.desc("rerank_score"), tie)
    scored = found.withColumn("rerank_score", scorer)
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= top_n)


def candidates(found: DataFrame, keywords: dict = KEYWORDS, doc_col: str = "document_id", text_col: str = "text", rank_col: str = "rank") -> DataFrame:
    """One row a document: its best-ranked chunk, tagged."""
    first = found.groupBy(doc_col).agg(F.min_by(F.struct(F.col(text_col).alias("text"), F.col(rank_col).alias("rank")), rank_col).alias("c"))
    return first.select(F.col(doc_col).alias("paper_id"), F.col("c.rank").alias("rank"), primary_tag("c.text", keywords).alias("tag"))


def source_texts(chunks: DataFrame, most: int = 5000) -> DataFrame:
    """A document's chunk texts in order, joined by a space and cut."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_ord", "text")))
    return chunks.groupBy("document_id").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), " "), 1, most).alias("source_text"))


def first_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.min_by("text", "chunk_ord").alias("text"), F.count("*").alias("n_chunks"))


__all__ = ["among", "candidates", "chunks", "cosine", "first_chunks", "nearest", "over_fetch", "ranked_again", "rerank", "score_all", "source_texts", "top_k"]
