"""Fuzzy deduplication of papers and their ranking."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, strip, title_tokens
from .storage import saved

#: Tokens of a set that is joined on several at once, so many at most, and so many combinations for one size; rows of a set in an array.
SMALL, JOINT, COMBINED, BLOCK = 24, 3, 20, 1000


def similarity(a, b) -> Column:
    """Jaccard of two token arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(col(a), col(b)))
    either = F.size(col(a)) + F.size(col(b)) - both
    return F.when((F.size(col(a)) == 0) | (F.size(col(b)) == 0), F.lit(0.0)).otherwise(both / either)


def _shared(a: int, b: int, least: float) -> int:
    """The fewest tokens that sets of a and b tokens share whose Jaccard similarity is at least `least`."""
    return math.ceil(least / (1 + least) * (a + b) - 1e-9)


def _joint(a: int, b: int, least: float) -> int:
    """How many tokens sets of these sizes are joined on at once: as many as keep their combinations few."""
    o = _shared(a, b, least)
    fits = [j for j in range(2, min(JOINT, o) + 1) if math.comb(max(a, b) - o + j, j) <= COMBINED]
    return max(fits, default=1)


def _combinations(n: int, j: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(n), j))


def signatures(size: int, least: float) -> list[tuple[int, int, tuple[int, ...]]]:
    """(smaller size, larger size, places): where a set of `size` tokens, rarest first, stands for meeting sets of each size it may be similar to.

    Two sets that share o tokens share j of them among the first size - o + j of each, in one order of all tokens."""
    out = []
    for other in range(max(1, math.ceil(size * least - 1e-9)), math.floor(size / least + 1e-9) + 1):
        o, j = _shared(size, other, least), _joint(min(size, other), max(size, other), least)
        if 0 < o <= min(size, other):
            out += [(min(size, other), max(size, other), c) for c in _combinations(min(size, size - o + j), j)]
    return out


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity), a < b, of different sets (id, tokens sorted and distinct, not empty) of a Jaccard similarity of at least `least`.

    Sets of up to SMALL tokens meet on combinations of their rarest tokens (signatures), larger ones with each other and with these on single
    tokens of their prefixes: of the first size - ceil(least * size) + 1 tokens in the order of rising frequency two such sets share one."""
    each = sets.select("id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("n"))
    ranked = each.join(common, "token").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ranked"))
    ranked = saved(ranked, "ranked")
    places = [(s, a, b, list(c)) for s in range(1, SMALL + 1) for a, b, c in signatures(s, least) if a <= SMALL]
    large = range(SMALL + 1, math.floor(SMALL / least + 1e-9) + 1)  # that may be similar to small ones
    places += [(s, a, b, list(c)) for s in large for a, b, c in signatures(s, least) if a <= SMALL]
    table = sets.sparkSession.createDataFrame(places, "size int, a int, b int, places array<int>").groupBy("size").agg(F.collect_list(F.struct("a", "b", "places")).alias("where"))
    small = ranked.join(F.broadcast(table), "size")  # a row for each size
    taken = lambda w: F.transform(w["places"], lambda i: F.get("ranked", i))
    keys = F.filter(F.transform("where", lambda w: F.struct(w["a"].alias("x"), w["b"].alias("y"), taken(w).alias("t"))), lambda k: F.forall(k["t"], lambda t: t["n"] > 1))
    small = small.select("id", "size", F.explode(F.transform(keys, lambda k: F.xxhash64(k["x"], k["y"], F.transform(k["t"], lambda t: t["token"])))).alias("key"))
    one, two = small.alias("x"), small.alias("y")
    pairs = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    prefix = F.slice("ranked", F.lit(1), (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int"))
    single = ranked.where(F.col("size") > SMALL).select("id", "size", F.explode(F.filter(prefix, lambda t: t["n"] > 1)["token"]).alias("token"))
    one, two = single.alias("x"), single.alias("y")
    fits = F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * least - 1e-9
    long = one.join(two, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    pairs = pairs.union(long).distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return pairs.withColumn("similarity", similarity("ta", "tb")).where(F.col("similarity") >= least).select("a", "b", "similarity")


def similar_pairs(rows: DataFrame, least: float, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """(a, b, similarity) with a < b and Jaccard similarity of at least `least` (above 0).

    Equal sets are one, so only different sets are compared (similar_sets). Rows are put in for the sets at the end, BLOCK of a set with BLOCK of
    the other in one row of two arrays: the pairs themselves, as many as the square of a set's rows, are made where they are read
    and never shuffled."""
    given = rows.select(F.col(id_col).alias("id"), F.sort_array(tokens_col).alias("tokens")).where((F.size("tokens") > 0) & F.col("id").isNotNull())
    given = saved(given, "given")
    count = saved(given.groupBy("tokens").agg(F.count("*").alias("rows")).select("tokens", "rows", F.monotonically_increasing_id().alias("set")), "sets")
    found = similar_sets(count.select(F.col("set").alias("id"), "tokens"), least)
    parts = F.ceil(F.col("rows") / BLOCK).cast("int")
    blocks = given.join(count, "tokens").groupBy("set", F.pmod(F.xxhash64("id"), parts).alias("part")).agg(F.collect_list("id").alias("ids"))
    blocks = saved(blocks, "blocks")
    same = count.where("rows > 1").select(F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("similarity"))
    left, right = blocks.select(F.col("set").alias("a"), F.col("part").alias("pa"), F.col("ids").alias("x")), blocks.select(F.col("set").alias("b"), F.col("part").alias("pb"), F.col("ids").alias("y"))
    met = found.union(same).join(left, "a").join(right, "b").where("a < b OR pa <= pb")
    met = met.repartition(F.xxhash64("a", "b", "pa", "pb"))
    inner = (F.col("a") == F.col("b")) & (F.col("pa") == F.col("pb"))
    pairs = met.select("similarity", inner.alias("inner"), F.explode("x").alias("p"), "y").select("similarity", "inner", "p", F.explode("y").alias("q"))
    return pairs.where((F.col("p") < F.col("q")) | (~F.col("inner") & (F.col("p") > F.col("q")))).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def first_come(rows: DataFrame, pairs: DataFrame, fixed: Column | None = None, most_rounds: int = 200) -> DataFrame:
    """Greedy in the order of ord, all rows at once: a row is accepted unless an earlier accepted row is similar, and else
    goes into the first such. Rows that `fixed` marks are accepted beforehand.

    rows: (ord, ...); pairs: (a, b) of similar rows, a < b. Each round decides every row whose earlier neighbours are
    all decided; rounds are as many as the longest chain of decisions. Returns (ord, into): into = ord if accepted."""
    state = rows.select("ord", F.when(fixed, F.col("ord")).alias("into") if fixed is not None else F.lit(None).cast("long").alias("into"))
    touched = pairs.select(F.col("b").alias("ord")).distinct().withColumn("near", F.lit(True))
    state = state.join(touched, "ord", "left").select("ord", F.coalesce("into", F.when(F.col("near").isNull(), F.col("ord"))).alias("into"))
    state = saved(state, "greedy")
    for _ in range(most_rounds):
        if state.where("into IS NULL").isEmpty():
            return state
        open_rows = state.where("into IS NULL").select(F.col("ord").alias("b"))
        before = pairs.join(open_rows, "b").join(state.select(F.col("ord").alias("a"), "into"), "a")
        seen = before.groupBy("b").agg(
            F.count_if(F.col("into").isNull()).alias("waits"), F.min(F.when(F.col("into") == F.col("a"), F.col("a"))).alias("host"),
            F.min(F.when(F.col("into").isNull(), F.col("a"))).alias("waits_for"),
        )
        ready = (F.col("waits") == 0) | (F.col("host") < F.col("waits_for"))
        decided = seen.where(ready).select(F.col("b").alias("ord"), F.coalesce("host", "b").alias("now"))
        state = saved(state.join(decided, "ord", "left").select("ord", F.coalesce("into", "now").alias("into")), "greedy")
    raise RuntimeError("the chain of decisions is longer than the rounds allowed")


def merged(rows: DataFrame, into: str = "into") -> DataFrame:
    """One row for each host: its own fields, the first PDF address among its rows, all alternatives in order, the most
    citations, the highest relevance. Year, abstract, authors and open access are not merged."""
    own = rows.where(F.col("ord") == F.col(into))
    by = rows.groupBy(F.col(into).alias("host")).agg(
        F.min_by("pdf_url", F.when(F.coalesce("pdf_url", F.lit("")) != "", F.col("ord"))).alias("m_pdf"),
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("pdf_alternatives", F.array().cast("array<string>")).alias("p")))), lambda x: x["p"]))).alias("m_alt"),
        F.max("citation_count").alias("m_cites"), F.max("relevance_score").alias("m_rel"),
    )
    out = own.join(by, own["ord"] == by["host"]).withColumn("pdf_url", F.coalesce("m_pdf", "pdf_url")).withColumn("pdf_alternatives", F.col("m_alt"))
    return out.withColumn("citation_count", F.col("m_cites")).withColumn("relevance_score", F.col("m_rel")).drop("host", "m_pdf", "m_alt", "m_cites", "m_rel")


def title_key(title) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), r"\s*\([0-9]{4}\)\s*", " "))


def deduplicate(papers: DataFrame, threshold: float = 0.82, exact: float = 0.95) -> DataFrame:
    """papers: ord (a number that orders them), title, doi, pdf_url, pdf_alternatives, citation_count, relevance_score, ...

    Equal DOIs merge; so do equal titles (less a year) without DOI. Then, DOI rows first, each row without DOI goes into the
    first accepted row of title similarity `threshold`; last, all accepted rows are compared in turn at `exact`."""
    doi = strip(F.lower(F.coalesce("doi", F.lit(""))))
    has = doi != ""
    key = F.when(has, F.concat(F.lit("d"), doi)).otherwise(F.concat(F.lit("t"), title_key("title")))
    rows = papers.withColumn("has_doi", has).withColumn("into", F.min("ord").over(Window.partitionBy(key)))
    rows = saved(merged(rows).drop("into"), "papers")
    numbered = saved(rows.withColumn("old", F.col("ord")).withColumn("ord", _dense(rows, ["has_doi", "ord"])), "papers")
    for level, fixed in ((threshold, F.col("has_doi")), (exact, None)):
        tokens = numbered.select(F.col("ord").alias("id"), title_tokens("title").alias("tokens"))
        pairs = saved(similar_pairs(tokens, level).select("a", "b"), "pairs")
        numbered = saved(merged(numbered.join(first_come(numbered, pairs, fixed), "ord")).drop("into"), "papers")
    return numbered.drop("has_doi", "ord").withColumnRenamed("old", "ord")


def _dense(rows: DataFrame, by: list[str]) -> Column:
    """DOI rows before the others, each by ord: ord itself, the others lifted above every ord."""
    most = rows.agg(F.max("ord").alias("m")).collect()[0]["m"] or 0
    return F.when(F.col("has_doi"), F.col("ord")).otherwise(F.col("ord") + most + 1)


def search_statistics(found: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: raw, the papers found (rows of found), and of those left after dedup unique_papers, with_pdf (a PDF's address that isn't
    empty) and open_access (is_oa; null is not). Empty tables give zeros. Two aggregates that meet as one row each."""
    pdf = F.coalesce("pdf_url", F.lit("")) != ""
    left = unique.agg(F.count("*").alias("unique_papers"), F.count_if(pdf).alias("with_pdf"), F.count_if(F.coalesce("is_oa", F.lit(False))).alias("open_access"))
    return found.agg(F.count("*").alias("raw")).join(F.broadcast(left))
