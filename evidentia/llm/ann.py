"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stored

#: Rows that fit the codebooks, centroids of a half, rows of an index block, share of the rows that a query reranks.
SAMPLE, CENTROIDS, BLOCK, SHARE = 8000, 32, 4096, 0.65


def usable(vector) -> F.Column:
    """Not null, without null or non-finite components, not zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm; starts from rows spread over the sample, so reruns agree."""
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = half_distances(x, centres).argmin(1)
        for c in range(k):
            own = x[nearest == c]
            if len(own):
                centres[c] = own.mean(0)
    return centres


def half_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]


def fit_codebooks(rows: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> list[np.ndarray]:
    """A codebook for each half of the vectors, from at most `sample` rows chosen by a hash of their id."""
    n = rows.count()
    share = min(1.0, 2.0 * sample / max(n, 1))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy(F.xxhash64("id"), "id").limit(sample)
    x = [np.asarray(v, np.float64) for v in some.select("v").toPandas()["v"]]
    if not x:
        return []
    x = np.stack(x)
    half = max(1, x.shape[1] // 2)
    return [kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids) if x.shape[1] > half else np.zeros((1, 0))]


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells in the order of d1[i] + d2[j], by a heap over the sorted distances, until they hold `want` entries."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, cells, held = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * len(d2) + int(o2[j])
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return cells


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows found for each query (never the query's own id), by Euclidean distance in double precision.

    Two codebooks quantise the halves of a vector; a row's cell is its pair of centroids. Cells are split into blocks of
    about BLOCK rows by a hash of the id, so no cell is too large for a task. A query visits cells by summed
    distance until they hold `share` of all rows (and k + 1 at least), computes exact distances in each block and keeps
    its k best there, ties to smaller ids; a window ranks what the blocks return. All rows are indexed.

    Vectors that are null, zero or of another length than most (ties: the shorter), or hold null or non-finite
    components, take no part on either side; equal vectors are entries of their own. Rows that repeat an id are one entry for
    each different vector. Fewer candidates than k: all of them. Returns query_id, rank, id_col, score.
    """
    spark = rows.sparkSession
    entries = stored(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable("v") & F.col("id").isNotNull()).distinct(), "vectors")
    asked = stored(queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable("v") & F.col("id").isNotNull()).distinct(), "queries")
    lengths = entries.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()  # one row
    dims = lengths[0]["dims"] if lengths else 0
    entries, asked = entries.where(F.size("v") == dims), asked.where(F.size("v") == dims).repartition(shuffle_width(spark))
    books = fit_codebooks(entries)
    out = f"query_id {entries.schema['id'].dataType.simpleString()}, {id_col} {entries.schema['id'].dataType.simpleString()}, score double"
    if not books:
        return spark.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), id_col, "score")
    half = books[0].shape[1]
    sent = spark.sparkContext.broadcast(books)  # 2 x CENTROIDS vectors

    @F.pandas_udf("int")
    def cell_of(vs: pd.Series) -> pd.Series:
        one, two = sent.value
        x = np.stack(vs.to_numpy()).astype(np.float64) if len(vs) else np.zeros((0, dims))
        return pd.Series(half_distances(x[:, :half], one).argmin(1) * len(two) + half_distances(x[:, half:], two).argmin(1), dtype="int32")

    index = stored(entries.withColumn("cell", cell_of("v")), "index")
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)  # one number a cell, CENTROIDS squared at most
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    want = max(k + 1, int(np.ceil(share * counts.sum())))
    splits = np.maximum(1, -(-counts // BLOCK))
    sent_counts = spark.sparkContext.broadcast((counts, splits))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = sent.value
        counts, splits = sent_counts.value
        for batch in batches:
            for at, v in zip(batch["id"], batch["v"]):
                x = np.asarray(v, np.float64)[None]
                cells = traverse(half_distances(x[:, :half], one)[0], half_distances(x[:, half:], two)[0], counts, want)
                pairs = [(c, s) for c in cells for s in range(splits[c])]
                yield pd.DataFrame({"cell": [c for c, _ in pairs], "split": [s for _, s in pairs], "id": at, "v": [v] * len(pairs)})

    id_type = entries.schema["id"].dataType.simpleString()
    v_type = entries.schema["v"].dataType.simpleString()
    probes = asked.mapInPandas(probe, f"cell int, split int, id {id_type}, v {v_type}")
    parts = F.element_at(F.array(*[F.lit(int(s)) for s in splits]), F.col("cell") + 1)
    blocks = index.withColumn("split", F.pmod(F.xxhash64("id"), parts).cast("int"))

    def rerank(key, asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(block):
            block = block.sort_values("id", kind="stable")
            ids, x = block["id"].to_numpy(), np.stack(block["v"].to_numpy()).astype(np.float64)
            for q, v in zip(asked["id"], asked["v"]):
                d = x - np.asarray(v, np.float64)
                d = np.sqrt(np.einsum("ij,ij->i", d, d))
                d[ids == q] = np.inf
                best = np.lexsort((ids, d))[:k] if len(d) <= 4 * k else (c := np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]))[np.lexsort((ids[c], d[c]))][:k]
                best = best[np.isfinite(d[best])]
                found.append(pd.DataFrame({"query_id": q, id_col: ids[best], "score": d[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], id_col: [], "score": []})

    near = probes.groupBy("cell", "split").cogroup(blocks.groupBy("cell", "split")).applyInPandas(rerank, out)
    order = Window.partitionBy("query_id").orderBy("score", id_col)
    best = near.dropDuplicates(["query_id", id_col, "score"]).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "score")
