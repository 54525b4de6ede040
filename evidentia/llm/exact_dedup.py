"""Exact dedup through an extendible-hash index kept as files in the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, NARROW, ascii_lower, broadcast_if_small, shuffle_width, spread_join, stored


@dataclass(frozen=True)
class Directory:
    """Buckets by the leading bits of a 64-bit hash: all of `depth` bits; those in the table splits[i] (bucket) by i + 1 more."""

    depth: int
    splits: tuple[DataFrame, ...]

    def place(self, rows: DataFrame) -> DataFrame:
        """rows, which have h, with their bucket. The directory is a table that is joined; nothing of it is in the plan."""
        rows = rows.withColumn("bucket", _prefix(F.col("h"), self.depth))
        for i, full in enumerate(self.splits):
            rows = rows.join(broadcast_if_small(full.withColumn("full", F.lit(True)), NARROW), "bucket", "left")
            deeper = F.when(F.col("full"), _prefix(F.col("h"), self.depth + i + 1)).otherwise(F.col("bucket"))
            rows = rows.withColumn("bucket", deeper).drop("full")
        return rows


def _prefix(h: Column, bits: int) -> Column:
    """The first `bits` bits under a leading 1, so that prefixes of different lengths differ; all 64 bits are the hash itself."""
    if bits == 0:
        return F.lit(1).cast("long")
    return h if bits >= 64 else F.shiftrightunsigned(h, 64 - bits) + F.lit(1 << bits if bits < 63 else -(1 << 63)).cast("long")


def grow_directory(keys: DataFrame, capacity: int) -> Directory:
    """Double the directory until no bucket holds more than `capacity` of the distinct hashes in keys (h). One hash is one
    chain however many copies it has, so copies never split a bucket. The directory begins with the doublings that bring the mean
    under a quarter of the capacity, so of even hashes a bucket is hardly ever overfull; if hashes share leading bits, the
    buckets that are overfull split on, each round by a bit. The codes of these stay in tables."""
    depth, count = 0, keys.count()
    while count * 4 > capacity << depth:
        depth += 1
    splits: list[DataFrame] = []
    while depth + len(splits) < 62:
        now = Directory(depth, tuple(splits))
        counted = now.place(keys).groupBy("bucket").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        full = stored(counted.where((F.col("n") > capacity) & (F.col("low") != F.col("high"))).select("bucket"), "splits")
        if full.isEmpty():
            return now
        splits.append(full)
    return Directory(depth, tuple(splits))


def owner(h: Column, width: int) -> Column:
    """The task, of `width`, that owns a hash: ranges of the hash's values, of equal size."""
    return F.shiftrightunsigned(F.shiftrightunsigned(h, 40) * F.lit(width).cast("long"), 24).cast("int")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, hashed: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """Groups of equal texts: identical after lower-casing A-Z only.

    1. A scan keeps (id, row, hash, digest) of every row and counts the rows of a hash. 2. The directory doubles while buckets
    are overfull. 3. Every text goes to the task that owns its range of hashes, those of a hash with more than HEAVY rows to several by
    row. An owner compares the bytes of texts with one hash and makes an entry for each different text; entries of one hash
    are chained by digest. They are the index: a range of buckets a file, in their order. 4. Every row looks its entry up by bucket,
    hash and digest, which the same ranges hold; what it returns is the entry's.

    Returns one row per row of docs: id_col, keep_id, group_size, kept, text_sha256, bucket, chain. The largest id stays; of
    repeated rows with that very id, exactly one. A null text counts as empty; null ids come last and stay only where a whole
    group has none. An empty table gives an empty result. hashed: the hash, of 64 bits; equal ones only make chains longer.
    """
    width = shuffle_width(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    src = src.withColumn("h", hashed(F.col("norm"))).withColumn("row", F.monotonically_increasing_id())
    rows = stored(src.select("id", "row", "h", F.sha2("norm", 256).alias("sha")), "rows")
    keys = stored(rows.groupBy("h").agg(F.ceil(F.count("*") / HEAVY).cast("int").alias("parts")), "keys")
    directory = grow_directory(keys, capacity)
    heavy = stored(keys.where("parts > 1"), "heavy")
    some = not heavy.isEmpty()
    dealt = src.join(broadcast_if_small(heavy, NARROW), "h", "left") if some else src.withColumn("parts", F.lit(1))
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1)))
    at = F.pmod(owner(F.col("h"), width) + F.pmod("row", F.col("parts")), F.lit(width)).cast("int")
    owned = dealt.withColumn("owner", at).repartitionById(width, "owner")
    entries = owned.groupBy("owner", "h", "norm").agg(F.count("*").alias("copies"), F.max("id").alias("keep_id"), F.max("parts").alias("parts"))
    entry = ["h", F.sha2("norm", 256).alias("sha"), "copies", "keep_id"]
    if some:
        met = entries.where("parts > 1").groupBy("h", "norm").agg(F.sum("copies").alias("copies"), F.max("keep_id").alias("keep_id"))
        entries = entries.where("parts = 1").select(*entry).union(met.select(*entry))
    else:
        entries = entries.select(*entry)
    # which of the rows with the largest id: by the numbers that were written, as a second scan may number rows otherwise
    stays = rows.groupBy("h", "sha").agg(F.max(F.struct("id", "row")).alias("top")).select("h", "sha", F.col("top.row").alias("stays"))
    entries = directory.place(stored(entries.join(stays, ["h", "sha"]), "entries"))
    chain = F.row_number().over(Window.partitionBy("owner", "bucket", "h").orderBy("sha"))
    index = entries.withColumn("owner", owner(F.col("h"), width)).repartitionById(width, "owner").withColumn("chain", chain)
    index = stored(index.withColumn("group_size", F.col("copies")).sortWithinPartitions("bucket", "h").drop("owner"), "index")
    return spread_join(directory.place(rows), index, "bucket", "h", "sha", n="copies").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("stays")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        "chain",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops; all columns stay."""
    groups = stored(exact_groups(docs, id_col, text_col).select(F.col(id_col).alias("k_id"), "keep_id", "kept", F.col("text_sha256").alias("k_sha")), "groups")
    sha = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256)
    kept = groups.where("kept").select("k_id", "k_sha")
    out = docs.join(kept, docs[id_col].eqNullSafe(kept["k_id"]) & (sha == kept["k_sha"]), "left_semi")
    if not groups.where("NOT kept AND k_id <=> keep_id").isEmpty():  # one id with one text in several rows
        out = out.withColumn("evidentia_sha", sha).dropDuplicates([id_col, "evidentia_sha"]).drop("evidentia_sha")
    return out
