"""Hard negatives for anchors, found by angular triangle filtering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stored

#: Reference directions and the rows (a bounded sample, by a hash of the id) they are chosen from; rows and anchors of a block.
REFERENCES, SAMPLE, ROWS, ANCHORS = 16, 2000, 4096, 1024
#: Added to every angle bound; angles are exact to about 1e-14.
SLACK = 1e-9
#: Norm from which on a score might not fit a long.
TOO_LONG = float(1 << 31)


def angles(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of each row of x to each unit direction, exact also near 0 and pi; 0 for a zero row."""
    norm = np.sqrt((x * x).sum(1))
    u = x / np.where(norm > 0, norm, 1.0)[:, None]
    near = np.stack([np.sqrt(((u - r) ** 2).sum(1)) for r in directions], 1)
    far = np.stack([np.sqrt(((u + r) ** 2).sum(1)) for r in directions], 1)
    return np.where(norm[:, None] > 0, 2 * np.arctan2(near, far), 0.0)


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k unit directions among the rows of x, each as far as can be from those before it."""
    norm = np.sqrt((x * x).sum(1))
    u = x[norm > 0] / norm[norm > 0, None]
    if not len(u):
        return np.eye(1, x.shape[1])
    chosen = [0]
    closest = u @ u[0]
    while len(chosen) < min(k, len(u)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, u @ u[chosen[-1]])
    return u[chosen]


def score_bounds(norm: float, angle: np.ndarray, norms: np.ndarray, stored_angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers that the inner product of an anchor with each row can't be under or over.

    On the sphere two vectors at angles s and t to a direction are at least |s - t| and at most min(s + t, 2 pi - s - t)
    apart. Each direction gives such an interval; their intersection gives one of cosines, which the norms scale."""
    together = stored_angles + angle
    least = np.maximum(np.abs(stored_angles - angle).max(1) - SLACK, 0.0)
    most = np.minimum(np.minimum(together, 2 * np.pi - together).min(1) + SLACK, np.pi)
    scale = norm * norms
    margin = 1e-9 * scale + 1e-6
    return np.floor(scale * np.cos(most) - margin), np.ceil(scale * np.cos(least) + margin)


class _Block:
    """Rows of a block as arrays."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.whole = np.stack(rows["q"].to_numpy()).astype(np.int64)
        self.norms, self.angles = rows["norm"].to_numpy(), np.stack(rows["angles"].to_numpy())
        self.real = self.whole.astype(np.float64)

    def scores(self, at: np.ndarray, anchor: np.ndarray, norm: float) -> np.ndarray:
        """Integer inner products; in floating point where every partial sum is a whole number under 2 ** 53."""
        if len(at) and norm * self.norms[at].max() < float(1 << 52):
            return np.rint(self.real[at] @ anchor.astype(np.float64)).astype(np.int64)
        return (self.whole[at] * anchor).sum(1)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def _best_positives(k: int, out: list[str]):
    def best(key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(rows):
            block = _Block(rows)
            for a, label, q, norm, angle in zip(anchors["id"], anchors["label"], anchors["q"], anchors["norm"], anchors["angles"]):
                at = np.flatnonzero((block.labels == label) & (block.ids != a))
                if len(at) > k:
                    low, high = score_bounds(norm, angle, block.norms[at], block.angles[at])
                    at = at[high >= np.partition(low, len(at) - k)[len(at) - k]]  # k rows score at least that
                scores = block.scores(at, np.asarray(q, np.int64), norm)
                top = _first(block.ids[at], scores, k)
                found.append(pd.DataFrame({out[0]: a, out[1]: block.ids[at][top], out[2]: scores[top]}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in out})

    return best


def _best_negatives(k: int, low_share: int, high_share: int, out: list[str]):
    def best(key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(rows):
            block = _Block(rows)
            columns = ("id", "label", "q", "norm", "angles", "positives", "positive_scores")
            for a, label, q, norm, angle, positives, wanted in zip(*(anchors[c] for c in columns)):
                other = np.flatnonzero(block.labels != label)
                low, high = score_bounds(norm, angle, block.norms[other], block.angles[other])
                windows, met = [], np.zeros(len(other), np.bool_)
                for p, s in zip(positives, wanted):
                    bottom, top = -(-low_share * int(s) // 100), high_share * int(s) // 100
                    if bottom > top:  # a negative score has no window
                        continue
                    overlap = (low <= top) & (high >= bottom)
                    sure = low[overlap & (low >= bottom) & (high <= top)]
                    if len(sure) >= k:
                        overlap &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                    met |= overlap
                    windows.append((p, int(s), bottom, top))
                at = other[met]
                scores, ids = block.scores(at, np.asarray(q, np.int64), norm), block.ids[at]
                for p, s, bottom, top in windows:
                    inside = np.flatnonzero((scores >= bottom) & (scores <= top))
                    inside = inside[_first(ids[inside], scores[inside], k)]
                    found.append(pd.DataFrame({out[0]: a, out[1]: p, out[2]: s, out[3]: ids[inside], out[4]: scores[inside]}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in out})

    return best


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Hard negatives: for each anchor (the rows for which the condition `anchors` holds) and each of its `positives` best rows
    of the same label, the `negatives` best rows of other labels that score low to high percent of the positive's score.

    A component x counts as floor(256 * x); scores are integer inner products, higher first, ties to smaller ids. With
    every row its norm and its angles to REFERENCES directions are stored. Anchors and rows are dealt into
    blocks by hashes of their ids, and every block of anchors meets every block of rows, so no task holds more than two blocks.
    There the angles bound each pair's score (score_bounds). For positives only rows are scored whose upper bound
    reaches the lower bound of that many others; for negatives only those whose bounds overlap the window of a positive and
    aren't under what enough rows surely in it score. Bounds choose what is scored, never what is returned.

    No part take: rows with a null id, label or vector, null or non-finite components, an empty vector, another number of
    components than most rows have (ties: the smaller), or a norm of 2 ** 31 (in 256ths) or more, whose scores might not
    fit a long. Rows that repeat an id count once, by the smallest label, then vector. A zero vector scores 0. Anchors whose
    positives have negative scores give no rows. Empty in, empty out. ids and labels are whole numbers.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    id_type = rows.schema[id_col].dataType.simpleString()
    src = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = src.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.coalesce(F.size("v"), F.lit(0)) > 0) & F.coalesce(finite, F.lit(False)))
    real = F.transform("v", lambda x: F.lit(256.0) * x.cast("double"))
    src = src.withColumn("norm", F.sqrt(F.aggregate(F.transform(real, lambda x: F.pow(x - F.pmod(x, F.lit(1.0)), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)))
    src = src.where(F.col("norm") < TOO_LONG).select("id", "label", "anchor", F.transform(real, lambda x: F.floor(x).cast("int")).alias("q"))
    whole = src.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r"), F.max("anchor").alias("anchor"))
    whole = stored(whole.select("id", "r.label", "r.q", "anchor"), "rows")
    lengths = whole.groupBy(F.size("q").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()  # one row
    out = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    schema = f"anchor_id {id_type}, positive_id {id_type}, positive_score long, negative_id {id_type}, negative_score long"
    if not lengths:
        return spark.createDataFrame([], schema).select("anchor_id", "positive_id", F.lit(1).alias("rank"), "negative_id", "positive_score", "negative_score")
    whole = whole.where(F.size("q") == lengths[0]["dims"])
    n, n_anchors = whole.agg(F.count("*"), F.count_if("anchor")).first()
    share = min(1.0, 2.0 * SAMPLE / n)
    some = whole.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    some = some.select("q").toPandas()["q"]  # at most SAMPLE rows
    directions = farthest_first(np.stack(some.to_numpy()).astype(np.float64), REFERENCES) if len(some) else np.eye(1, lengths[0]["dims"])
    sent = spark.sparkContext.broadcast(directions)  # REFERENCES vectors

    @F.pandas_udf("struct<norm: double, angles: array<double>>")
    def measured(q: pd.Series) -> pd.DataFrame:
        x = np.stack(q.to_numpy()).astype(np.float64) if len(q) else np.zeros((0, sent.value.shape[1]))
        return pd.DataFrame({"norm": np.sqrt((x * x).sum(1)), "angles": list(angles(x, sent.value))})

    index = stored(whole.withColumn("m", measured("q")).select("id", "label", "q", "anchor", "m.norm", "m.angles"), "index")
    blocks, groups = -(-n // ROWS), max(1, -(-n_anchors // ANCHORS))
    every = lambda name, k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    dealt = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    columns = ["id", "label", "q", "norm", "angles"]
    asked = index.where("anchor").select(*columns, dealt(groups).alias("group"))
    held = index.select(*columns, dealt(blocks).alias("block"), every("group", groups)).repartition(shuffle_width(spark), "group", "block")

    def meet(left: DataFrame, best, columns: list[str], kept: int, partition: list[str]) -> DataFrame:
        left = left.select("*", every("block", blocks))
        types = ", ".join(f"{c} long" if c.endswith("score") else f"{c} {id_type}" for c in columns)
        near = left.groupBy("group", "block").cogroup(held.groupBy("group", "block")).applyInPandas(best, types)
        order = Window.partitionBy(*partition).orderBy(F.desc(columns[-1]), columns[-2])
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)

    names = ["anchor_id", "id", "score"]

    def best_first(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best_positives(positives, names)(key, a, b)

    def best_second(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best_negatives(negatives, low, high, out)(key, a, b)

    liked = meet(asked, best_first, names, positives, ["anchor_id"])
    liked = liked.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # `positives` rows at most
    liked = stored(liked.select("anchor_id", F.col("p.id").alias("positives"), F.col("p.score").alias("positive_scores")), "positives")
    asked = stored(asked.join(liked.withColumnRenamed("anchor_id", "id"), "id"), "asked")
    mined = meet(asked, best_second, out, negatives, ["anchor_id", "positive_id"])
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
