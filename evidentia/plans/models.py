"""Model calls behind small protocols, with offline defaults that depend on content alone."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_terms, words
from ..functions.vectors import hash_embed, let


class Embedder(Protocol):
    dim: int

    def embed(self, text: Column) -> Column: ...


class HashEmbedder:
    """Hashed token counts, as an expression: no Python per row."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        return hash_embed(words(F.lower(text)), self.dim)


def arrow_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int):
    """An embedder from a loader of a model: it loads once a Python worker and encodes an Arrow batch at a time."""

    @F.pandas_udf("array<float>")
    def run(batches):
        import pandas as pd

        model = load()
        for texts in batches:
            yield pd.Series(model([t or "" for t in texts]))

    class Model:
        def embed(self, text: Column) -> Column:
            return run(text)

    Model.dim = dim
    return Model()


class Chat(Protocol):
    def chat(self, messages: list[dict]) -> str: ...


class OfflineChat:
    """Answers without a model: no gaps, no search, nothing supported."""

    def chat(self, messages: list[dict]) -> str:
        return "NO GAPS. ANSWER"


def lexical_score(query: Column, text: Column, terms: Column | None = None) -> Column:
    """The default re-ranker: the share of the query's terms (derived from it unless given) that occur in the text."""
    share = lambda found, low: F.size(F.filter(found, lambda t: F.contains(low, t))) / F.size(found)
    score = lambda found: F.when(F.size(found) == 0, F.lit(0.0)).otherwise(let(F.lower(text), lambda low: share(found, low)))
    return let(query_terms(query) if terms is None else terms, score)


def prompt(messages: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """(by, prompt): system texts under one [System] mark, then the marked turns in order; blank ones are left out."""
    from ..functions.text import strip

    body = strip(F.coalesce("text", F.lit("")))
    told = messages.select(by, order, F.coalesce("role", F.lit("user")).alias("role"), body.alias("body")).where("body <> ''")
    name = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise(F.col("role"))
    row = F.struct(order, F.when(F.col("role") == "system", F.col("body")).otherwise(F.concat(F.lit("["), name, F.lit("]\n"), "body")).alias("t"), (F.col("role") == "system").alias("sys"))
    rows = told.groupBy(by).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    pick = lambda want: F.transform(F.filter("rows", lambda r: r["sys"] == want), lambda r: r["t"])
    system = F.when(F.size(pick(True)) > 0, F.concat(F.lit("[System]\n"), F.array_join(pick(True), "\n\n")))
    turns = F.when(F.size(pick(False)) > 0, F.array_join(pick(False), "\n"))
    return rows.select(by, strip(F.concat_ws("\n\n", system, turns)).alias("prompt"))


def excerpts(found: DataFrame, most: int, chars: int, by: str = "query_id", doc_col: str = "document_id") -> DataFrame:
    """(by, excerpts): of each query's found rows (rank, text) the first `most`, each `chars` long at most, as numbered lines."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col(doc_col).cast("string"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    rows = found.where(F.col("rank") <= most).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))
    return rows.select(by, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("excerpts"))


def decision_prompt(queries: DataFrame, found: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, prompt) for queries (by, query): six excerpts of 350 characters, and whether to search further."""
    shown = queries.join(excerpts(found, 6, 350, by), by, "left")
    ask = F.lit("Reply ANSWER if these excerpts cover the question; else reply SEARCH: and one query for what is missing.")
    return shown.select(by, F.concat(F.lit("Question: "), "query", F.lit("\n\n"), F.coalesce("excerpts", F.lit("(nothing found)")), F.lit("\n\n"), ask).alias("prompt"))


def answer_prompt(queries: DataFrame, found: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, prompt) for queries (by, query): ten excerpts of 500 characters, to be answered with citations."""
    shown = queries.join(excerpts(found, 10, 500, by), by, "left")
    ask = F.lit("Answer from the excerpts alone and cite their numbers in brackets.")
    return shown.select(by, F.concat(F.lit("Question: "), "query", F.lit("\n\n"), F.coalesce("excerpts", F.lit("(nothing found)")), F.lit("\n\n"), ask).alias("prompt"))


def critique_prompt(title: Column, description: Column, draft: Column) -> Column:
    """A node's title, description and the first 1,000 characters of its draft, to be answered NO GAPS or GAPS: a | b."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    ask = F.lit("\n\nWhat does the draft lack? Reply NO GAPS, or GAPS: with the missing topics, parted by |.")
    return F.concat(F.lit("Section: "), blank(title), F.lit("\nAbout: "), blank(description), F.lit("\nDraft: "), F.substring(blank(draft), 1, 1000), ask)
