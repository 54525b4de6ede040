"""Spelling variants: words within one edit, grouped under their most frequent form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NARROW, ascii_lower, broadcast_if_small, shuffle_width, stored

#: A word before lower-casing: letters of Latin-1, the two signs among them included.
RUN = "[A-Za-zÀ-ÿ]+"
#: Words of a list beyond which it is dealt again by half of what its words don't share; words that search a list at a time.
MOST, ASKED = 4096, 8192
#: Distances over one edit.
FAR = np.uint8(2)


def occurrences(docs: DataFrame, noise: int | None = 31, least: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): every maximal run of letters of the whole texts, A-Z lower-cased, of at least `least` code points. With noise, h being
    the crc32 of "<id>:<run>", a run for which noise divides h first loses its code point h % length. Null text has none;
    a null id is written as nothing."""
    low = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), ascii_lower(F.col(text_col)).alias("t"))
    runs = low.select("id", F.explode(F.filter(F.regexp_extract_all("t", F.lit(RUN), F.lit(0)), lambda w: F.char_length(w) >= least)).alias("w"))
    if noise is None:
        return runs.select(F.col("w").alias("word"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "w").cast("binary")))
    at = F.pmod("h", F.char_length("w")).cast("int")
    cut = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
    return runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("w")).alias("word")).where(F.char_length("word") >= least)


def vocabulary(words: DataFrame, least: int = 2) -> DataFrame:
    """(id, word, n) of the words that occur `least` times or more, sorted by code points; so are the ids."""
    counted = stored(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least), "counted")
    ordered = counted.repartitionByRange(shuffle_width(words.sparkSession), "word").sortWithinPartitions("word")
    return stored(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def _halves(rest: Column, m: Column, key: Column) -> Column:
    """Of words that are one edit apart and of which the longer has m code points, m - 1 lie before or after the edit: so they
    share the first m // 2, or the last m - m // 2. Both lists: struct(key, m, rest), rest being what isn't shared by key."""
    k = F.floor(m / 2).cast("int")
    first = F.struct(F.concat(key, F.lit("<"), F.substr(rest, F.lit(1), k)).alias("key"), (m - k).alias("m"), F.substr(rest, k + 1).alias("rest"))
    cut = F.char_length(rest) - (m - k)
    last = F.struct(F.concat(key, F.lit(">"), F.substr(rest, cut + 1)).alias("key"), k.alias("m"), F.substr(rest, F.lit(1), cut).alias("rest"))
    return F.array(first, last)


def lists(words: DataFrame, most: int = MOST) -> DataFrame:
    """(key, m, rest, id, n): words dealt into lists such that any two within one edit meet in a list whose m is the length of
    the longer one's rest. A list with more than `most` words is dealt again by half of its rests; as rests of one code point or
    none can't make more words than there are letters, that ends, and no list is too long for a task."""
    length = F.char_length("word")
    each = words.select("id", "n", F.col("word").alias("rest"), F.explode(F.array(length, length + 1)).alias("m"))
    each = each.select("id", "n", F.explode(_halves(F.col("rest"), F.col("m"), F.col("m").cast("string"))).alias("l")).select("id", "n", "l.*")
    while True:
        hashed = each.withColumn("h", F.xxhash64("key"))
        heavy = stored(hashed.where("m > 1").groupBy("h").count().where(F.col("count") > most).select("h", F.lit(True).alias("heavy")), "heavy")
        if heavy.isEmpty():
            return each
        hashed = hashed.join(broadcast_if_small(heavy, NARROW), "h", "left")
        itself = F.array(F.struct("key", "m", "rest"))
        split = F.when(F.col("heavy") & (F.col("m") > 1), _halves(F.col("rest"), F.col("m"), F.col("key"))).otherwise(itself)
        each = stored(hashed.select("id", "n", F.explode(split).alias("l")).select("id", "n", "l.*"), "lists")


def near_in_lists(lo: np.ndarray, hi: np.ndarray, rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs (i, j) of rests of one list exactly one edit apart. rests: sorted within each list; lo[i], hi[i]: the list
    of i begins at lo[i] and ends before hi[i].

    All words search their sorted lists at once. A stretch of neighbours whose LCPs reach d shares the first d rows
    of the edit matrix with the searching word, so a row is computed once a stretch, in a band of three cells:
    from row d to d + 1 a stretch parts where an LCP is d. Where a whole row exceeds one edit, the stretch is skipped."""
    size = np.fromiter(map(len, rests), np.int64, len(rests))
    codes = np.frombuffer("".join(rests).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.append(codes, np.zeros(1, np.uint32))  # what is read beyond a word's end doesn't count
    off, n, end = np.cumsum(size) - size, len(rests), len(codes) - 1
    lcp = np.full(n + 1, -1, np.int64)
    open_ = np.flatnonzero(lo[1:] == lo[:-1]) + 1
    lcp[open_] = 0
    for d in range(int(size.max(initial=0))):
        open_ = open_[(size[open_] > d) & (size[open_ - 1] > d)]
        open_ = open_[codes[off[open_] + d] == codes[off[open_ - 1] + d]]
        if not len(open_):
            break
        lcp[open_] += 1
    found = []
    for first in range(0, n, ASKED):
        q = np.arange(first, min(n, first + ASKED))
        a, b = lo[q], hi[q]
        band = np.empty((3, len(q)), np.uint8)
        band[0], band[1], band[2] = FAR, 0, np.where(size[q] > 0, 1, FAR)
        d = 0
        while len(q):
            ends = size[a] == d  # the word that is the shared prefix itself comes first
            gap = size[q] - d + 1
            here = np.flatnonzero(ends & (gap >= 0) & (gap <= 2))
            hit = here[band[gap[here], here] == 1]
            found.append((q[hit], a[hit]))
            a = a + ends
            left = a < b
            q, a, b, band = q[left], a[left], b[left], band[:, left]
            starts = np.flatnonzero(lcp <= d)  # with n, at the end
            at, upto = np.searchsorted(starts, a), np.searchsorted(starts, b)
            count = upto - at
            which = np.repeat(np.arange(len(q)), count)
            child = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            q, a, b, band = q[which], starts[child], starts[child + 1], band[:, which]
            letter = codes[off[a] + d]
            other = lambda i: letter != codes[np.minimum(off[q] + max(i, 0), end)]  # noqa: B023, E731
            row = np.empty_like(band)
            row[0] = np.where(size[q] >= d, np.minimum(band[0] + other(d - 1), band[1] + 1), FAR)
            row[1] = np.where(size[q] > d, np.minimum(np.minimum(band[1] + other(d), band[2] + 1), row[0] + 1), FAR)
            row[2] = np.where(size[q] > d + 1, np.minimum(band[2] + other(d + 1), row[1] + 1), FAR)
            band = np.minimum(row, FAR)
            keep = band.min(0) < FAR if len(q) else np.zeros(0, np.bool_)
            q, a, b, band = q[keep], a[keep], b[keep], band[:, keep]
            d += 1
    one = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    two = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return one, two


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, m, rest, id, n) sorted by key and rest: (id, near, near_n), in stretches of whole lists."""

    def compare(lists: pd.DataFrame) -> pd.DataFrame:
        start = np.flatnonzero(np.append(True, lists["key"].to_numpy()[1:] != lists["key"].to_numpy()[:-1]))
        size = np.diff(np.append(start, len(lists)))
        lists = lists[np.repeat(size > 1, size)]  # a word that meets no other
        size = size[size > 1]
        lo = np.repeat(np.cumsum(size) - size, size)
        rests, m = lists["rest"].tolist(), lists["m"].to_numpy()
        i, j = near_in_lists(lo, lo + np.repeat(size, size), rests)
        long = np.fromiter(map(len, rests), np.int64, len(rests))
        own = np.maximum(long[i], long[j]) == m[i]  # two shorter ones belong to the lists of their own length
        i, j = i[own], j[own]
        ids, n = lists["id"].to_numpy(), lists["n"].to_numpy()
        return pd.DataFrame({"id": ids[i], "near": ids[j], "near_n": n[j]})

    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(held):
            continue
        last = int(np.searchsorted(held["key"].to_numpy() == held["key"].iloc[-1], True))  # whole lists before the last one
        if last:
            yield compare(held.iloc[:last])
            held = held.iloc[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield compare(held)


def group_variants(words: DataFrame, ratio: int = 10, most: int = MOST) -> DataFrame:
    """Group a vocabulary, as vocabulary() gives it, under its frequent forms.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its near
    word of largest n (ties: the first in code-point order) if that n is at least `ratio` times its own. Its root is what the
    forms of forms end in: as n grows by `ratio` each time, doubling finds it in a few rounds.

    Near words meet in sorted lists (lists()) and are found by dynamic programming over these (near_in_lists()). A hot prefix
    or suffix is split by further letters until its lists are short, so nothing is capped. Returns one row a word: word,
    form, root, n, n_near, form_n. Words of any length; an empty vocabulary gives no rows.
    """
    spark = words.sparkSession
    dealt = lists(words, most).repartition(shuffle_width(spark), "key").sortWithinPartitions("key", "rest")
    pairs = dealt.select("key", "m", "rest", "id", "n").mapInPandas(_pairs, "id long, near long, near_n long").distinct()  # two lists may show one pair
    best = pairs.groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("first"))).alias("top"))
    told = words.join(best, "id", "left")
    strong = F.col("top.near_n") >= ratio * F.col("n")
    told = told.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("top.first")).alias("form_id"), F.when(strong, F.col("top.near_n")).alias("form_n"),
    )
    told = stored(told, "told")
    links = told.where("form_id IS NOT NULL").select("id", "form_id", F.col("form_id").alias("root_id"))
    open_ = True
    while open_:
        further = links.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        links = stored(links.join(further, "root_id", "left").select("id", "form_id", F.coalesce("further", "root_id").alias("root_id"), F.col("further").isNotNull().alias("moved")), "roots")
        open_ = not links.where("moved").isEmpty()
        links = links.drop("moved")
    name = lambda c: words.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    named = links.join(name("form"), "form_id").join(name("root"), "root_id").select("id", "form", "root")
    return told.join(named, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
