"""Fuzzy line dedup by MinHash over character shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW, TEXTS, broadcast_if_small, give_back, is_small, linked_parts, parity, shuffle_width, spread_join, stored
from .shingles import mixed

#: Characters of a shingle; bands and rows of a signature; pairs of one line that a task verifies together; characters
#: whose shingles are in memory at a time; lines that a task remembers so as not to send them again; bits of a bitmap a
#: shingle.
CHARS, BANDS, ROWS, MEET, STRETCH, REMEMBER, SPREAD = 10, 12, 4, 256, 1 << 19, 200_000, 2
#: Signatures that a task sorts into ranges at a time; signatures among which a task looks for lone ones.
RUN, MOST = 1 << 18, 4_000_000
U32, U64 = np.uint32, np.uint64
#: A line's number, size and signatures; one signature of a line.
SIGNED = np.dtype([("rep", "<i8"), ("n", "<i4"), ("sigs", "<u8", (BANDS,))])
POSTING = np.dtype([("sig", "<u8"), ("rep", "<i8"), ("n", "<i4")])
_seeds = mixed(np.arange(1, BANDS * ROWS + 1, dtype=U64)).astype(U32) | U32(1)
_blank, _odd = re.compile(r"[\x20\x09-\x0D]+"), ("  ", "\t", "\x0b", "\x0c", "\r")


def normal_lines(text: str) -> list[str]:
    """The lines of a text as they are compared: A-Z lower-cased, each run of white space one space, none at the ends."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes, only A-Z
    if any(x in text for x in _odd):
        return [_blank.sub(" ", x).strip(" ") for x in text.split("\n")]
    return [x.strip(" ") for x in text.split("\n")]


def number(line: str) -> int:
    """64 bits, signed, that stand for a normal line."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of the lines, one line after another, and their counts. A line of fewer than CHARS
    characters has itself as its one shingle."""
    short = [x if len(x) >= CHARS else x + "\0" * (CHARS - len(x)) for x in lines]
    code = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), U32)
    size = np.fromiter(map(len, short), np.int64, len(short))
    h = np.zeros(len(code) - CHARS + 1, U32)
    for i in range(CHARS):
        h = h * U32(0x01000193) + code[i : len(code) - CHARS + 1 + i] * U32(0x9E3779B1)
    h = (h ^ (h >> U32(16))) * U32(0x85EBCA6B)
    inside = np.ones(len(code), np.bool_)
    for i in range(1, CHARS):
        inside[np.cumsum(size) - i] = False  # those would reach into the next line
    return (h ^ (h >> U32(13)))[inside[: len(h)]], size - CHARS + 1


def bands(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """BANDS 64-bit keys for each line, of ROWS minima of permuted shingle hashes each; counts of shingles, with repeats."""
    h, sizes = shingle_hashes(lines)
    starts = np.cumsum(sizes) - sizes
    held = np.empty_like(h)
    out = np.zeros((len(lines), BANDS), U64)
    for b in range(BANDS):
        key = np.full(len(lines), b + 1, U64)
        for r in range(ROWS):
            key = key * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(np.multiply(h, _seeds[b * ROWS + r], out=held), starts).astype(U64)
        out[:, b] = mixed(key)
    return out, sizes


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """For each normal line the sorted distinct 64-bit hashes of its shingles; the sets share an array."""
    short = [x if len(x) >= CHARS else x + "\0" * (CHARS - len(x)) for x in lines]
    code = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), U32)
    end = np.cumsum(np.fromiter(map(len, short), np.int64, len(short)))
    first = np.append(0, end[:-1])
    h = np.zeros(len(code) - CHARS + 1, U64)
    for i in range(CHARS):
        h *= U64(0x9E3779B97F4A7C15)
        h += code[i : len(code) - CHARS + 1 + i]
    h = mixed(h)
    new = np.zeros(len(h) + 1, np.bool_)  # shingles over the border of two lines stay out
    for a, b in zip(first.tolist(), (end - CHARS + 1).tolist()):
        h[a:b].sort()
        new[a:b] = True
    new[1:-1] &= h[1:] != h[:-1]
    new[first] = True
    new = new[:-1]
    before = np.append(0, np.cumsum(new))
    h = h[new]
    return [h[a:b] for a, b in zip(before[first].tolist(), before[end - CHARS + 1].tolist())]


def shingle_strings(line: str) -> set[str]:
    return {line[i : i + CHARS] for i in range(max(1, len(line) - CHARS + 1))}


def similar(x: set[str], y: set[str]) -> bool:
    """Jaccard similarity 0.8 or more."""
    both = len(x & y)
    return 100 * both >= 80 * (len(x) + len(y) - both)


def _common(x: str, y: str) -> int:
    """With how many same characters two strings begin."""
    least, most = 0, min(len(x), len(y))
    while least < most:
        mid = (least + most + 1) // 2
        if x[least:mid] == y[least:mid]:
            least = mid
        else:
            most = mid - 1
    return least


def surely_similar(x: str, n: int, y: str) -> bool:
    """Whether what two normal lines begin and end with alike makes them similar(), without all their shingles; False leaves it open.
    n: at most as many shingles as x has. Those that lie within the common ends are shared, so at most the others are one line's alone."""
    begin = _common(x, y)
    low = max(0, begin - CHARS + 1)
    high = max(0, _common(x[begin:][::-1], y[begin:][::-1]) - CHARS + 1)
    if 2 * (low + high) < n:
        return False
    from_x, from_y = ({z[i : i + CHARS] for i in range(low, max(1, len(z) - CHARS + 1) - high)} for z in (x, y))
    return 100 * (n - len(from_x - from_y)) >= 80 * (n + len(from_y - from_x))


def _stretches(lines: list[str]) -> Iterator[list[str]]:
    """The lines in stretches of about STRETCH characters."""
    at = 0
    while at < len(lines):
        end, held = at, 0
        while end < len(lines) and held < STRETCH:
            held += len(lines[end]) + CHARS
            end += 1
        yield lines[at:end]
        at = end


def _sign(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """bands() of any number of lines, a stretch at a time."""
    found = [bands(some) for some in _stretches(lines)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


READ = "struct<line: array<long>, signed: binary>"


def _read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The numbers of a text's lines (null for those without visible characters), and of those that this task hasn't met, or
    not lately, the signatures (SIGNED)."""
    seen: set[int] = set()
    for texts in batches:
        numbers, counts, new, ends, lines = [], [], [], [0], []
        for text in texts:
            found = normal_lines(text.as_py() or "")
            counts.append(len(found))
            for line in found:
                n = number(line) if line else None
                numbers.append(n)
                if n is not None and n not in seen:
                    seen.add(n)
                    new.append(n)
                    lines.append(line)
            ends.append(len(new))
        if len(seen) > REMEMBER:
            seen.clear()
        table = np.zeros(len(lines), SIGNED)
        if lines:
            table["rep"] = new
            table["sigs"], table["n"] = _sign(lines)
        signed = pa.array([table[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
        yield pa.StructArray.from_arrays([_lists(pa.array(numbers, pa.int64()), counts), signed], ["line", "signed"])


def _ranges(width: int):
    """Rows (signed): their signatures in runs, sorted into `width` ranges of values."""

    def run(tables: list[np.ndarray]) -> pd.DataFrame:
        table = np.concatenate(tables)
        posts = np.zeros(len(table) * BANDS, POSTING)
        posts["sig"], posts["rep"], posts["n"] = table["sigs"].ravel(), np.repeat(table["rep"], BANDS), np.repeat(table["n"], BANDS)
        part = ((posts["sig"] >> U64(32)) * U64(width) >> U64(32)).astype(np.uint16 if width <= 1 << 16 else np.int32)  # short ones sort fast
        order = np.argsort(part, kind="stable")
        part, posts = part[order], posts[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        return pd.DataFrame({"part": part[first].astype(np.int32), "posts": [x.tobytes() for x in np.split(posts, first[1:])]})

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, held = [], 0
        for batch in batches:
            tables.append(np.frombuffer(b"".join(batch["signed"]), SIGNED))
            held += len(tables[-1]) * BANDS
            if held >= RUN:
                yield run(tables)
                tables, held = [], 0
        if held:
            yield run(tables)

    return runs


def _rows(posts: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"sig": posts["sig"].astype(np.int64), "rep": posts["rep"], "n": posts["n"]})


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of whole ranges the signatures that two lines or more have. A task that gets more than MOST passes all on, as before
    it knows all it can't tell lone ones."""
    pieces, held = [], 0
    for batch in batches:
        found = [np.frombuffer(x, POSTING) for x in batch["posts"]]
        pieces += found
        held += sum(map(len, found))
        if held > MOST:
            yield from map(_rows, pieces)
            pieces = []
    if pieces and held <= MOST:
        posts = np.concatenate(pieces)
        pieces = []
        sig = np.ascontiguousarray(posts["sig"])
        order = np.argsort(sig)
        posts = posts[order[_shared(sig[order])]]
        posts = posts[np.lexsort((posts["rep"], posts["sig"]))]
        posts = posts[np.append(True, (posts["sig"][1:] != posts["sig"][:-1]) | (posts["rep"][1:] != posts["rep"][:-1]))[: len(posts)]]
        yield _rows(posts[_shared(posts["sig"])])
    give_back()


def _shared(values: np.ndarray) -> np.ndarray:
    """Which of these sorted values occur more than once."""
    same = values[1:] == values[:-1]
    return (np.append(False, same) | np.append(same, False))[: len(values)]


def postings_of(signed: DataFrame) -> DataFrame:
    """(sig, rep, n) of the lines in signed (SIGNED), without most signatures that only one line has: few others are left, so
    it is a pass over sorted numbers, not rows, that goes through all of them."""
    width = shuffle_width(signed.sparkSession)
    sent = signed.mapInPandas(_ranges(4 * width), "part int, posts binary").repartition(width, "part")
    return stored(sent.select("posts").mapInPandas(_met, "sig long, rep long, n int"), "postings", batch=TEXTS)


def _mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [x for some in _stretches([normal_lines(text)[0] for text in batch["text"]]) for x in shingle_sets(some)]
        yield pd.DataFrame({"rep": batch["line"], "n": [len(s) for s in sets], "bits": [parity(s, SPREAD) for s in sets]})


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a, own, b, text) sorted so that line a itself comes first: exact Jaccard of the shingles as strings, or a bound that decides it.
    Distinct hashes are at most as many as distinct shingles, so their number will do for the bound."""
    head, first, n, held = None, "", 0, None
    for batch in batches:
        found = []
        lines = [normal_lines(text)[0] for text in batch["text"]]
        sizes = iter([len(x) for some in _stretches([x for x, own in zip(lines, batch["own"]) if own]) for x in shingle_sets(some)])
        for a, own, b, line in zip(batch["a"].tolist(), batch["own"].tolist(), batch["b"].tolist(), lines):
            if own:
                head, first, n, held = a, line, next(sizes), None
            elif a == head:
                if not (sure := surely_similar(first, n, line)):
                    held = shingle_strings(first) if held is None else held
                if sure or similar(held, shingle_strings(line)):
                    found.append((a, b))
        yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of similar lines, over all documents, keep one.

    Lines lie between newlines and are compared in their normal form (normal_lines); lines without visible characters stay and
    take no part. Equal lines are one class, told apart by a 64-bit number. Classes whose sets of 10-character shingles
    have Jaccard similarity 0.8 or more are linked if they share one of 12 MinHash bands of 4 (at 0.8 all but
    (1 - 0.41) ** 12 = 0.2 % do, at 0.9 all but 3 in 100,000), a bound from bitmaps allows it and exact comparison
    agrees; linked_parts() keeps groups of near copies from making all their pairs. Of a component the line of the
    smallest (id, text hash, place) stays, all others go, so of a line that a document repeats too. How the table is
    dealt over partitions changes nothing.

    Rows that repeat an id with its very text share one decision. Null text counts as empty; null ids come first. Returns one
    row per row of docs: id_col, n_lines, n_dropped, text (the lines that stay; null stays null).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    read = stored(docs.withColumn("read", F.arrow_udf(_read, READ)("text")).select("id", "th", "read.line", "read.signed"), "read", batch=TEXTS)
    places = read.select("id", "th", F.posexplode("line").alias("nth", "line")).where("line IS NOT NULL")
    texts: list[DataFrame] = []

    def marks(reps: DataFrame) -> DataFrame:
        """Sizes and bitmaps of lines; their texts are fetched once, each from the document that owns it, and kept for links()."""
        reps = stored(reps.withColumnRenamed("rep", "line"), "reps")
        few = is_small(reps, NARROW)  # else a common line's places are better summed up before they meet
        own = places.join(F.broadcast(reps), "line", "left_semi") if few else places
        wanted = own.groupBy("line").agg(F.min(F.struct("id", "th", "nth")).alias("at"))
        wanted = wanted if few else wanted.join(reps, "line", "left_semi")
        wanted = stored(wanted.select("line", F.col("at.id").alias("w_id"), F.col("at.th").alias("w_th"), F.col("at.nth").alias("w_nth")), "wanted")
        some = broadcast_if_small(stored(wanted.select("w_id", "w_th").distinct(), "some"), NARROW)
        cut = docs.join(some, docs["id"].eqNullSafe(some["w_id"]) & (docs["th"] == some["w_th"]), "left_semi")
        cut = cut.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("nth", "text"))
        side = broadcast_if_small(wanted, NARROW)
        there = cut.join(side, cut["id"].eqNullSafe(side["w_id"]) & (cut["th"] == side["w_th"]) & (cut["nth"] == side["w_nth"]))
        texts.append(stored(there.select("line", "text").dropDuplicates(["line"]), "lines"))
        return texts[0].mapInPandas(_mark, "rep long, n long, bits binary")

    def links(pairs: DataFrame) -> DataFrame:
        degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEET).cast("int").alias("parts"))
        heads = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("rest"), F.col("a").alias("b"))
        others = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("rest"), "b")
        there = heads.union(others).join(texts[0].withColumnRenamed("line", "b"), "b")
        there = there.repartition(shuffle_width(spark), "a", "part").sortWithinPartitions("a", "part", "rest")
        return stored(there.select("a", (F.col("rest") == 0).alias("own"), "b", "text").mapInPandas(_verified, "a long, b long"), "links")

    parts = linked_parts(postings_of(read.select("signed")), marks, links)
    parts = broadcast_if_small(parts.withColumnRenamed("node", "line"), NARROW)
    placed = places.join(parts, "line", "left").select("id", "th", "nth", F.coalesce("component", "line").alias("part"))
    stays = placed.groupBy("part").agg(F.min(F.struct("id", "th", "nth")).alias("first"), F.count("*").alias("n"))
    gone = spread_join(placed, stored(stays.where("n > 1"), "stays"), "part").where("NOT (first <=> struct(id, th, nth))")
    gone = stored(gone.groupBy(F.col("id").alias("g_id"), F.col("th").alias("g_th")).agg(F.collect_set("nth").alias("drop")), "gone")
    if gone.agg(F.coalesce(F.sum(F.size("drop") + 3), F.lit(0)).alias("n")).first()["n"] <= NARROW:  # numbers, not rows
        gone = F.broadcast(gone)
    lines = F.split("text", "\n", -1)
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    kept = F.filter(lines, lambda _, i: ~F.array_contains("drop", i))
    return docs.join(gone, docs["id"].eqNullSafe(gone["g_id"]) & (docs["th"] == gone["g_th"]), "left").select(
        F.col("id").alias(id_col), F.coalesce(ends + 1, F.lit(0)).alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
