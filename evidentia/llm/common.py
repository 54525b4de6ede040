"""Helpers that several operators share: text normalisation, tables in the shared folder, size-checked
broadcasts and connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import shared_folder as shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of a join is broadcast only when a count shows that it has at most so many rows, of at most so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20
#: The same for rows of a few numbers.
NARROW = 1_000_000
#: Rows of one key beyond which spread_join deals them over several tasks.
HEAVY = 100_000
#: Rows with whole texts that a Python worker gets at a time.
TEXTS = 500
#: Sets of one signature that linked_parts compares in one place.
BLOCK = 512


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in; others keep their non-ASCII letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/evidentia-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, *partition_by: str, batch: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors and
    fixes the values of expressions that are not repeatable. batch: rows that a Python worker gets at a time, for rows
    with whole texts, of which 10,000 (the default) take much memory."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, usual = new_path(spark, name), spark.conf.get(key)
    try:
        if batch:
            spark.conf.set(key, str(batch))
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(key, usual)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def give_back() -> None:
    """At the end of a task: return what this Python worker has freed to the system, as idle workers stay beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory: lengths of strings, binaries and arrays, 8 for other columns."""
    total = F.lit(16)
    for field in df.schema:
        kind, c = field.dataType.typeName(), F.col(field.name)
        extra = F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 16 if kind in ("array", "map") else F.lit(0)
        total = total + 8 + F.coalesce(extra, F.lit(0))
    return total.cast("long")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table has at most `rows` rows and BROADCAST_BYTES bytes."""
    some = df.limit(rows + 1).select(row_bytes(df).alias("b")).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()  # one row
    return some["n"] <= rows and (some["b"] or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if it is_small; else leave the join to shuffle."""
    return F.broadcast(df) if is_small(df, rows) else df


def spread_join(rows: DataFrame, side: DataFrame, *key: str, n: str = "n") -> DataFrame:
    """rows joined with side, one row a key, in which column n counts the key's rows: those of a key with more than HEAVY
    rows are dealt over several tasks, to which its row of side is copied. They are dealt by a hash of their other columns, so
    a repeated task deals them alike. Column n is dropped."""
    side = side.withColumn("evidentia_parts", F.ceil(F.col(n) / HEAVY).cast("int")).drop(n)
    heavy = stored(side.where("evidentia_parts > 1").select(*key, "evidentia_parts"), "heavy")
    if heavy.isEmpty():
        return rows.join(side.drop("evidentia_parts"), [*key])
    dealt = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in key]), F.coalesce("evidentia_parts", F.lit(1)))
    rows = rows.join(broadcast_if_small(heavy, NARROW), [*key], "left").withColumn("evidentia_part", dealt.cast("int")).drop("evidentia_parts")
    side = side.withColumn("evidentia_part", F.explode(F.sequence(F.lit(0), F.col("evidentia_parts") - 1))).drop("evidentia_parts")
    return rows.join(side, [*key, "evidentia_part"]).drop("evidentia_part")


def no_clash(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Only the wanted columns, so that further ones cannot clash with an operator's own names."""
    return df.select(*wanted)


def _forest(batches):
    """Union-find over the edges of one partition, in bounded pieces: passes on at most one edge a node."""
    for edges in batches:
        a, b = edges["a"].to_numpy(), edges["b"].to_numpy()
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        roots = np.fromiter((root(x) for x in range(len(nodes))), np.int64, len(nodes))
        own = roots != np.arange(len(nodes))
        yield pd.DataFrame({"a": nodes[own], "b": nodes[roots[own]]})


def _labels(batches):
    """(node, component) of the whole graph that one task is given."""
    edges = list(batches)
    if edges:
        edges = pd.concat(edges, ignore_index=True)
        node = np.unique(edges[["a", "b"]].to_numpy())
        component = node.copy()
        for forest in _forest([edges]):
            component[np.searchsorted(node, forest["a"])] = forest["b"]
        yield pd.DataFrame({"node": node, "component": component})


def connected_components(edges: DataFrame, few: int = NARROW) -> DataFrame:
    """(node, component) of an undirected graph given as rows (a, b) of longs; component: its smallest node.

    Union-find within each task thins the edges to a forest; then every node takes the smallest label around it
    and the label of its label (pointer jumping) until nothing changes. Joins and partial sums only: the edges of
    a hub never meet in one task's memory. Up to `few` edges of that forest, by count, are one task's work: the same
    labels without a dozen jobs. Self-loops and repeated edges are harmless; an empty table gives none.
    """
    thin = stored(edges.select("a", "b").where("a <> b").mapInPandas(_forest, "a long, b long"), "forest")
    if thin.limit(few + 1).count() <= few:
        return stored(thin.coalesce(1).mapInPandas(_labels, "node long, component long"), "labels")
    both = stored(thin.union(thin.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:  # labels only fall, so it ends
        around = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        lower = labels.join(around, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("at"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        new = stored(lower.join(jump, "at", "left").select("node", "old", F.least("at", F.coalesce("further", "at")).alias("component")), "labels")
        labels = new.drop("old")
        if new.where("component <> old").isEmpty():
            return labels


def parity(tokens: np.ndarray, spread: int = 1) -> bytes:
    """A bitmap of about `spread` bits a token, each toggled by its tokens. Bits that differ between two sets' bitmaps are
    at most the tokens that only one set has."""
    bits = max(128, spread << max(0, int(len(tokens) - 1).bit_length()))
    on = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(on.astype(np.uint8)).tobytes()


class Bitmaps:
    """Bitmaps of several lengths, those of one length a table."""

    def __init__(self, bits: list[bytes]):
        self.words = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
        self.row, self.tables = np.zeros(len(bits), np.int64), {}
        for words in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == words)
            self.row[at] = np.arange(len(at))
            self.tables[words] = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), words)

    def differences(self, x: np.ndarray, other: Bitmaps, y: np.ndarray) -> np.ndarray:
        """For pairs of these (x) and other ones (y) a lower bound of the symmetric difference; of two lengths the longer one is
        folded to the shorter one's bits."""
        found = np.zeros(len(x), np.int64)
        code = self.words[x] << 32 | other.words[y]
        for pair in np.unique(code).tolist():
            at = np.flatnonzero(code == pair)
            a, b = pair >> 32, pair & 0xFFFFFFFF
            one, two = self.tables[a][self.row[x[at]]], other.tables[b][other.row[y[at]]]
            if a != b:
                one, two = (np.bitwise_xor.reduce(t.reshape(len(at), -1, min(a, b)), axis=1) for t in (one, two))
            found[at] = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
        return found


def _possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that their bitmaps don't rule out: Jaccard 0.8 leaves a symmetric difference of a ninth of both sizes."""
    for pairs in batches:
        each = np.arange(len(pairs))
        differ = Bitmaps(pairs["bits_a"].tolist()).differences(each, Bitmaps(pairs["bits_b"].tolist()), each)
        yield pairs.loc[9 * differ <= (pairs["n_a"] + pairs["n_b"]).to_numpy(), ["a", "b"]]
    give_back()


def possible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that the bitmaps of marks (rep, n, bits) don't rule out."""
    side = lambda c: marks.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    two = pairs.join(side("a"), "a").join(side("b"), "b")
    return two.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInPandas(_possible, "a long, b long")


def _closest_forest(pairs: np.ndarray, parts: np.ndarray, differ: np.ndarray, parent: dict[int, int]) -> np.ndarray:
    """Of pairs whose ends lie in components `parts`, closest first, those that join what earlier ones, noted in parent, haven't
    joined. The order doesn't depend on the block, so blocks with the same members choose the same pairs."""

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    chosen = []
    for i in np.lexsort((pairs[:, 1], pairs[:, 0], differ)).tolist():
        x, y = root(int(parts[i, 0])), root(int(parts[i, 1]))
        if x != y:
            parent[x] = y
            chosen.append(i)
    return pairs[chosen]


def _block_pairs(block: pd.DataFrame, joined: dict[int, int] | None) -> pd.DataFrame:
    """Pairs of one (sig, i, j) in different components, of different blocks if i <> j, that sizes and bitmaps don't rule out;
    with `joined` only those that join components, which it notes. Row r is compared with row r + 1, then all with r + 2, and so on: whole arrays at a time."""
    sig, i, j, own, rep, n, part = (block[c].to_numpy() for c in ("sig", "i", "j", "own", "rep", "n", "part"))
    bits = Bitmaps(block["bits"].tolist())
    pairs, parts, differs = [], [], []
    for step in range(1, len(block)):
        x, y = slice(None, -step), slice(step, None)
        same = (sig[x] == sig[y]) & (i[x] == i[y]) & (j[x] == j[y])
        if not same.any():
            break
        fits = same & (part[x] != part[y]) & ((i[x] == j[x]) | (own[x] != own[y])) & (80 * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y]))
        at = np.flatnonzero(fits)
        if len(at):
            differ = bits.differences(at, bits, at + step)
            close = 9 * differ <= n[at] + n[at + step]
            at, differ = at[close], differ[close]
            pairs.append(np.sort(np.stack([rep[at], rep[at + step]], 1), 1))
            parts.append(np.stack([part[at], part[at + step]], 1))
            differs.append(differ)
    found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    if len(found):
        found = np.unique(found, axis=0) if joined is None else _closest_forest(found, np.concatenate(parts), np.concatenate(differs), joined)
    return pd.DataFrame(found, columns=["a", "b"])


def _compared(thin: bool):
    """Rows (sig, i, j, own, rep, n, part, bits) sorted by sig, i, j: _block_pairs of every stretch of whole blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, joined = None, {} if thin else None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            key = batch[["sig", "i", "j"]].to_numpy()
            last = int((~(key == key[-1]).all(1)).cumsum()[-1]) if len(batch) else 0
            yield _block_pairs(batch.iloc[:last], joined)
            held = batch.iloc[last:]
        if held is not None:
            yield _block_pairs(held, joined)
        held = joined = None
        give_back()

    return run


def linked_parts(postings: DataFrame, marks: Callable[[DataFrame], DataFrame], links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of sets that are linked by Jaccard similarity 0.8 or more.

    postings: (sig, rep, n): set rep, of about n elements, has signature sig; repeated rows do no harm. marks(reps) gives (rep,
    n, bits): exact sizes and bitmaps (parity) of these sets. links(pairs) returns those of the pairs (a, b) that are linked.

    First each set is tried with the smallest set of a signature that it meets most often. Then, while a signature has sets
    in different components, its sets lie in blocks of about BLOCK, and those of a block are compared by size and bitmap;
    twice only as many of the pairs that pass are tried as could join the components, and that is linear in the sets. What
    signatures still hold apart is compared block with block, and every pair that passes is tried: rows of that step are a
    BLOCK-th of the square of a signature's sets. So of sets that share a signature each pair is tried, ruled out by a
    bound, or joined already.
    """
    by_size = Window.partitionBy("sig").orderBy("n", "rep")
    whole = by_size.rowsBetween(Window.unboundedPreceding, 0)
    met = postings.select("sig", "rep", "n", F.first("rep").over(whole).alias("head"), F.first("n").over(whole).alias("head_n"), F.lead("rep").over(by_size).alias("next"))
    shared = stored(met.where("(rep <> head OR next <> rep) AND NOT (next <=> rep)").drop("next"), "shared")
    sizes = stored(marks(shared.select("rep").distinct()), "marks", batch=TEXTS)
    near = shared.where("rep <> head AND n * 80 <= head_n * 100")
    tries = near.groupBy("rep", "head").agg(F.count("*").alias("times"))
    best = tries.groupBy("rep").agg(F.max_by("head", F.struct("times", "head")).alias("head"))
    tried = stored(best.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct(), "tried")
    found = links(stored(possible(tried, sizes), "possible"))
    parts, new = None, True
    for turn, thin in enumerate((True, True, False)):
        parts = connected_components(found) if new else parts
        side = broadcast_if_small(parts.withColumnRenamed("node", "rep"), NARROW)
        placed = shared.select("sig", "rep").join(side, "rep", "left").select("sig", "rep", F.coalesce("component", "rep").alias("part"))
        held = placed.groupBy("sig").agg(F.count("*").alias("g"), F.min("part").alias("low"), F.max("part").alias("high"), F.min("rep").alias("top"))
        # powers of two, so that blocks of signatures with the same sets agree
        blocks = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("g") / BLOCK)))).cast("int")
        held = stored(held.where("low <> high").select("sig", "top", blocks.alias("blocks")), "open")
        if held.isEmpty():
            break
        apart = placed.join(broadcast_if_small(held, NARROW), "sig").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("blocks")).cast("int"))
        others = F.array("own") if thin else F.sequence(F.lit(0), F.col("blocks") - 1)
        apart = apart.withColumn("other", F.explode(others)).join(sizes, "rep")
        apart = apart.select("top", "sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "part", "bits")
        # signatures of the same sets mostly begin with the same one: dealt by it, a task sees their pairs together
        apart = apart.repartition(shuffle_width(postings.sparkSession), "top", "i", "j").sortWithinPartitions("top", "sig", "i", "j", "rep")
        pairs = apart.drop("top").mapInPandas(_compared(thin), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        new = not pairs.isEmpty()
        if new:
            tried, found = tried.union(pairs), found.union(links(pairs))
    else:
        parts = connected_components(found) if new else parts
    return parts
