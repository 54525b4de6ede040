"""Exact Jaccard join of documents on word n-grams by token-combination prefixes."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW, TEXTS, broadcast_if_small, give_back, linked_parts, parity, shuffle_width, spread_join, stored
from .shingles import U, mixed, set_key, shingle_sets, word_shingles, words_key

#: A token in so many sets is frequent; raised until the table of frequent tokens has at most MOST_FREQUENT rows.
FREQUENT = 10
MOST_FREQUENT = 4_000_000
#: Tokens are counted by their leading bits: so many, the first of them for the range that a task counts.
KEY_BITS, RANGE_BITS = 48, 8
#: A task counts tokens in runs of about so many.
RUN = 1_000_000
#: Pairs of one set that a task verifies together.
MEET = 256


def _bounds() -> list[int]:
    """Sizes that begin the intervals i; sets of a link lie in one interval or in neighbouring ones."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(max(found[-1] + 1, 5 * (found[-1] - 1) // 4 + 1))
    return found


BOUNDS = _bounds()


def combinations(tokens: np.ndarray) -> np.ndarray:
    """Signatures of combinations of tokens; linked sets share one.

    Level l is for the sets of intervals l - 1 and l, so a set has two levels and linked ones share one. There, linked
    sets differ in at most d = 2 * (most size) // 9 tokens. Tokens fall into g > d groups by hash; what differs touches d
    groups, so some group holds the same combination of tokens, three or four mostly, in both sets. Combinations are
    the signatures. If no more than d groups of a set hold any token, its empty ones count too: then that holds as well
    when the equal groups are empty ones, which both sets then have.

    Why not all k-token combinations of a prefix extended by k - 1 tokens: a set of n tokens has a prefix of n // 5 + 1, and if
    that is frequent throughout, binomial(n // 5 + k, k) combinations: 2,628 pairs for 350 tokens, against about n / 2
    = 175 here, and it is the large groups of near copies that are frequent throughout. Nor can the groups be
    formed within the prefix: two linked sets' prefixes end at different tokens, so a group near the end would differ
    although the sets agree on it; over the whole sets, only what differs touches a group.
    """
    found, at = [], bisect.bisect_right(BOUNDS, len(tokens)) - 1
    for level in (at, at + 1):
        d = 2 * (BOUNDS[level + 1] - 1) // 9
        g = d + d // 7 + 3
        group = (mixed(tokens ^ U(level)) % U(g)).astype(np.int64)
        with np.errstate(over="ignore"):
            total = np.zeros(g, U)
            np.add.at(total, group, mixed(tokens + U(level)))
            held = np.bincount(group, minlength=g)
            sig = mixed(total ^ mixed(np.arange(g, dtype=U) * U(0x9FB21C651E98DF25) + U(level)) + held.astype(U))
        some = held > 0
        found.append(sig[some] if int(some.sum()) > d else sig)
    return np.concatenate(found)


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """What a set is indexed under; linked sets (Jaccard 0.8 or more) share a signature.

    A linked set lacks at most m = size // 5 of these tokens. In the order of rare tokens by hash, then frequent ones, the
    m + 1 first are a prefix of which a linked set has one. If all are rare, each is a signature. Else all rare tokens
    are, and the prefix extends over the frequent ones as combinations(). Two linked sets of the first kind share a token
    of the shorter prefix; so do a set of the first and one of the second kind, whose rare tokens are all indexed;
    two of the second kind share a combination.
    """
    need = len(tokens) // 5 + 1
    if not len(frequent):
        return tokens[:need]
    keys = tokens >> U(64 - KEY_BITS)
    at = np.searchsorted(frequent, keys)
    at[at == len(frequent)] = 0
    rare = tokens[frequent[at] != keys][:need]
    return rare if len(rare) == need else np.unique(np.concatenate([rare, combinations(tokens)]))


def packed(x: np.ndarray) -> bytes:
    """Numbers under 2 ** 48 byte by byte: the upper, mostly empty bytes lie together and compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    planes = np.zeros((len(x) // 6, 8), np.uint8)
    planes[:, :6] = np.frombuffer(x, np.uint8).reshape(6, -1).T
    return planes.view("<u8")[:, 0].astype(U)


def frequent_tokens(docs: DataFrame, text_col: str, make: Callable[[Iterable[str]], Iterator[np.ndarray]]) -> np.ndarray:
    """The leading bits of tokens that FREQUENT or more sets hold, sorted; exact over all texts (equal sets in a run count once); make: the
    sets of texts, as sorted distinct hashes.

    A task sorts the tokens of a run of sets and sends, for each range of token values, the differences and counts:
    about 3 bytes a token. A range is counted by one task; there are at least four ranges a shuffle partition. Only the order of
    tokens depends on the table, results don't: tokens are told apart by KEY_BITS bits, and above MOST_FREQUENT rows
    the least frequent ones count as rare."""
    width = max(1 << RANGE_BITS, 4 * shuffle_width(docs.sparkSession))
    drop = U(64 - KEY_BITS)
    step = (1 << KEY_BITS) // width + 1

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, held, seen = [], 0, set()

        def run():
            token = np.concatenate(sets)
            token.sort()  # in place: the run is the most that a worker holds
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            token, n = token[first], np.diff(np.append(first, len(token)))
            at = (token // U(step)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(at)) + 1
            rows = [(int(r[0]), int(t[0]), packed(np.diff(t)), packed(c.astype(U))) for r, t, c in zip(np.split(at, cuts), np.split(token, cuts), np.split(n, cuts))]
            return pd.DataFrame(rows, columns=["part", "first", "gaps", "counts"])

        for batch in batches:
            for tokens in make(batch[text_col]):
                if len(tokens) and (key := set_key(tokens)) not in seen:
                    seen.add(key)
                    sets.append(tokens >> drop)
                    held += len(tokens)
                if held >= RUN:
                    yield run()
                    sets, held, seen = [], 0, set()
        if sets:
            yield run()
        sets, seen = [], set()
        give_back()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        tokens = [np.concatenate([[U(f)], U(f) + np.cumsum(unpacked(g))]).astype(U) for f, g in zip(group["first"], group["gaps"])]
        token, at = np.unique(np.concatenate(tokens), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([unpacked(c) for c in group["counts"]])).astype(np.int64)
        often = n >= FREQUENT
        return pd.DataFrame({"token": token[often].astype(np.int64), "n": n[often]})

    sent = docs.select(text_col).mapInPandas(runs, "part int, first long, gaps binary, counts binary")
    counted = stored(sent.groupBy("part").applyInPandas(count, "token long, n long"), "frequent", batch=TEXTS)
    least = FREQUENT
    while counted.where(F.col("n") >= least).count() > MOST_FREQUENT:
        least = least * 3 // 2
    table = counted.where(F.col("n") >= least).select("token").toPandas()  # at most MOST_FREQUENT numbers
    return np.sort(table["token"].to_numpy(np.int64).astype(U))


def _similar(both: int, one: int, two: int) -> bool:
    return 100 * both >= 80 * (one + two - both)


def _verified(k: int):
    """Rows (a, part, b, text) sorted so that the text of a itself, with b null, comes before those to compare with it.
    Hashes of the shingles refuse most pairs; what they let pass is decided by the words themselves:
    100 * intersection >= 80 * union. One set and a stretch of texts are in memory at a time."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, own, tokens, shingles = None, None, np.zeros(0, U), None
        for batch in batches:
            found = []
            for a, b, text, other in zip(batch["a"].tolist(), batch["b"].tolist(), batch["text"], shingle_sets(batch["text"], k)):
                if b < 0:
                    head, own, tokens, shingles = a, text, other, None
                elif a == head:
                    if _similar(len(np.intersect1d(tokens, other, assume_unique=True)), len(tokens), len(other)):
                        shingles = word_shingles(own, k) if shingles is None else shingles
                        theirs = word_shingles(text, k)
                        if _similar(len(shingles & theirs), len(shingles), len(theirs)):
                            found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        own, tokens, shingles = None, None, None
        give_back()

    return check


def _parts(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, n, part) of the rows with words, th the text's hash and part the component's number; (id, th, n) of the others."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    frequent = frequent_tokens(docs, "text", lambda texts: shingle_sets(texts, k))
    sent = spark.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT rows

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = sent.value
        for batch in batches:
            sets = list(shingle_sets(batch["text"], k))
            yield pd.DataFrame({
                "id": batch["id"], "n": [len(s) for s in sets], "key": [words_key(t) for t in batch["text"]], "bits": [parity(s) for s in sets], "th": batch["th"],
                "sigs": [signatures(s, frequent).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets],
            })
        give_back()

    id_type = docs.schema["id"].dataType.simpleString()
    hashed = docs.withColumn("th", F.xxhash64("text"))
    rows = hashed.mapInPandas(index, f"id {id_type}, th long, n long, key binary, bits binary, sigs array<long>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows", batch=TEXTS)
    members = rows.where("n > 0").select("key", "row")
    classes = stored(members.groupBy("key").agg(F.min("row").alias("rep"), F.count("*").alias("n")), "classes")
    reps = rows.select("row", "n", "sigs").join(broadcast_if_small(classes.select(F.col("rep").alias("row")), NARROW), "row", "left_semi")
    postings = reps.select(F.col("row").alias("rep"), F.col("n").cast("int").alias("n"), F.explode("sigs").alias("sig"))

    def links(left: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are linked. Each a, and the b of its pairs, meet in one task, or for many pairs in
        several, by texts that are fetched by id and text hash."""
        degree = left.groupBy("a").agg(F.ceil(F.count("*") / MEET).cast("int").alias("parts"))
        heads = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("b"), F.col("a").alias("row"))
        others = left.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", F.col("b").alias("row"))
        wanted = stored(heads.union(others).join(rows.select("row", "id", "th"), "row").drop("row"), "wanted")
        texts = hashed.select(F.col("id").alias("t_id"), F.col("th").alias("t_th"), "text")
        if not rows.groupBy("id", "th").count().where("count > 1").join(wanted, ["th"], "left_semi").isEmpty():
            texts = texts.dropDuplicates(["t_id", "t_th"])  # rows that repeat an id with its text
        side = broadcast_if_small(wanted, NARROW)
        there = texts.join(side, texts["t_id"].eqNullSafe(side["id"]) & (texts["t_th"] == side["th"])).select("a", "part", "b", "text")
        there = there.repartition(shuffle_width(spark), "a", "part").sortWithinPartitions("a", "part", "b")
        return stored(there.select("a", "b", "text").mapInPandas(_verified(k), "a long, b long"), "links", batch=TEXTS)

    def marks(reps: DataFrame) -> DataFrame:
        return rows.select(F.col("row").alias("rep"), "n", "bits").join(broadcast_if_small(stored(reps, "reps"), NARROW), "rep", "left_semi")

    parts = linked_parts(postings, marks, links)
    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("part"), F.col("n").alias("copies"))
    placed = spread_join(rows.where("n > 0").select("id", "th", "n", "key"), of_class, "key", n="copies").drop("key")
    return stored(placed, "placed"), rows.where("n = 0").select("id", "th", "n")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """Components of documents linked by Jaccard similarity 0.8 or more of their sets of k-word shingles.

    Words are runs without space or \\t-\\r, A-Z lower-cased, of the whole text. A text of fewer than k words has its whole word
    sequence as its one shingle; without words (or null) a set is empty and linked with nothing, itself a component.

    Texts of the same words in the same order are one class. Classes are indexed by signatures() and linked by linked_parts():
    every pair that could link is compared exactly, ruled out by a bound, or already joined. Links are decided by words;
    64-bit hashes of shingles only choose what to compare, so a link is lost only if they collide within a pair's sets.

    Returns one row per row of docs: id_col, n_shingles, component_id (the smallest id in the component; nulls don't
    count, so it is null only if all ids there are). Repeated rows are rows of one class. Empty in, empty out.
    """
    placed, empty = _parts(docs, id_col, text_col, k)
    least = stored(placed.groupBy("part").agg(F.min("id").alias("component_id"), F.count("*").alias("copies")), "least")
    linked = spread_join(placed, least, "part", n="copies").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return linked.union(empty.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """docs with one row of each component, that of the smallest (id, text hash), nulls first; of rows that repeat an id with
    its text, one. Rows without words all stay. All columns stay."""
    placed, empty = _parts(docs, id_col, text_col, k)
    ones = placed.groupBy("part").agg(F.min(F.struct("id", "th")).alias("own")).select("own.id", "own.th")
    ids = stored(ones.union(empty.select("id", "th").distinct()).select(F.col("id").alias("k_id"), F.col("th").alias("k_th")), "kept")
    ids = broadcast_if_small(ids, NARROW)
    out = docs.join(ids, docs[id_col].eqNullSafe(ids["k_id"]) & (F.xxhash64(docs[text_col]) == ids["k_th"]), "left_semi")
    if placed.groupBy("id", "th").count().where("count > 1").isEmpty():
        return out
    words = F.rlike(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    return out.where(words).dropDuplicates([id_col, text_col]).union(out.where(~words))
