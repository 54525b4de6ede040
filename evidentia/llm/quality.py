"""Quality rules: figures of each text, and lines that too many documents of a host share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NARROW, ascii_lower, broadcast_if_small, is_small, spread_join, stored

#: Runs of white space; those within a line; what n_symbols counts.
SPACES, BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[\x20\x09\x0B-\x0D]+", "#*$%&|<>"
#: A text is refused with fewer words than FEWEST, or with more than MOST_REPEATED percent of them in repeated windows of WINDOW words.
FEWEST, MOST_REPEATED, WINDOW = 10, 20, 5
#: A line is boilerplate of its host when more than LINE_DOCS of the host's different texts and more than LINE_SHARE of them hold
#: it. A document is depleted when what is left has fewer than FEWEST words, or less than LEAST_LEFT of its words.
LINE_DOCS, LINE_SHARE, LEAST_LEFT = 10, 0.01, 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _neighbours(values: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The elements of a sorted array that are the same as the one before or after them."""
    last = lambda s, i: F.get(s, i - 1)
    return let(values, lambda s: F.filter(s, lambda x, i: F.coalesce((i > 0) & same(x, last(s, i)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False))))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many of the words lie in windows of `size` words that the array holds twice or more.

    Windows are sorted by 32 bits of a hash, their places beside them in one long; those that share these bits, few in most
    texts, are then compared word by word."""
    places = F.sequence(F.lit(0), F.size(words) - size)
    packed = F.transform(places, lambda p: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice(words, p + 1, size)), 33), 32) + p.cast("long"))
    maybe = _neighbours(F.sort_array(packed), lambda x, y: F.shiftrightunsigned(x, 32) == F.shiftrightunsigned(y, 32))
    window = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    named = F.transform(maybe, lambda x: F.struct(F.array_join(F.slice(words, window(x) + 1, size), " ").alias("w"), window(x).alias("p")))
    twice = _neighbours(F.sort_array(named), lambda x, y: x["w"] == y["w"])
    at = F.sort_array(F.transform(twice, lambda x: x["p"]))
    covered = let(at, lambda s: F.aggregate(F.transform(s, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(s, i + 1) - p, F.lit(size)))), F.lit(0), lambda t, n: t + n))
    return F.when(F.size(words) >= size, covered).otherwise(F.lit(0)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long")


def line_rows(text: Column) -> Column:
    """array<struct<a, b, words>> of the lines with a word: a 128-bit hash of the line, A-Z lower-cased and each run of white
    space one space, and its number of words."""
    normal = F.split(F.regexp_replace(ascii_lower(text), BLANKS, " "), "\n", -1)
    normal = F.filter(F.transform(normal, lambda x: F.trim(x)), lambda x: x != "")
    count = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), count(x).alias("words")))


def judge(
    docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_left: float = LEAST_LEFT,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """Judge every document by figures of its text and by how many documents share its lines.

    Words are runs without space or \\t-\\r. base_failed: fewer than 10 words, or more than 20 % of them in repeated windows of
    five. Else the lines decide: normalised lines are hashed (128 bits), the different texts of a host that hold a line are
    counted (copies of a text count once: exact dedup is another operator's work), lines above both limits are
    removed, and a document of which too little is left is rejected. A null host is a host of its own.

    Each text is read once, for narrow rows that are written; what is shuffled are hashes. A line of a third of all
    documents is counted by partial sums; its documents are dealt over tasks if removed lines are too many to broadcast.
    Null or empty texts have no words and fail; repeated rows are judged alike, null ids too. Empty in, empty out.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    host = F.when(F.col("host").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), "host"))
    symbols = F.char_length(F.regexp_replace(text, "[^" + SYMBOLS.replace("|", r"\|") + "]+", "")).cast("long")
    chars = F.char_length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long")
    figures = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    rows = src.select(
        "id", host.alias("host"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), figures.alias("f"), chars.alias("word_chars"),
        symbols.alias("n_symbols"), repeated_lines(text).alias("n_dup_lines"), line_rows(text).alias("lines"),
    )
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "*").select("*", "f.*").drop("f")
    rows = stored(rows, "rows")
    texts = stored(rows.groupBy("host", "t1", "t2").agg(F.count("*").alias("copies"), F.first("lines").alias("lines")), "texts")
    hosts = stored(texts.groupBy("host").agg(F.count("*").alias("docs")), "hosts")
    hashed = F.array_distinct(F.transform("lines", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    lines = texts.select("host", "copies", F.explode(hashed).alias("l")).groupBy("host", "l.a", "l.b").agg(F.count("*").alias("docs"), F.sum("copies").alias("n"))
    common = lines.where(F.col("docs") > line_docs).withColumnRenamed("docs", "of")
    common = common.join(broadcast_if_small(hosts), "host").where(F.col("of") > line_share * F.col("docs"))
    common = stored(common.select("host", "a", "b", "n"), "common")
    each = rows.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.a", "l.b", "l.words")
    if is_small(common, NARROW):
        met = each.join(F.broadcast(common), ["host", "a", "b"])
    else:
        met = spread_join(each, common, "host", "a", "b")
    gone = stored(met.groupBy("row").agg(F.sum("words").alias("removed")), "removed")
    told = rows.drop("lines", "t1", "t2").join(broadcast_if_small(gone, NARROW), "row", "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("removed")
    depleted = (F.col("removed") > 0) & ((left < FEWEST) | (left < least_left * F.col("n_words")))
    return told.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.col("removed").alias("n_removed_words"),
    )
