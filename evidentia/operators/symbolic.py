"""Paragraphs, tagged spans, triples and their resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_heading, phrase_kind, simple_sentences, strip


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line) of the lines with visible characters."""
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return cut.withColumn("line", strip("line")).where("line <> ''")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, part, heading, body): lines under the last heading above them; a heading without lines is lost. A document's lines
    are ordered within it, so the running count is per document."""
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("head", is_heading("line")).withColumn("part", F.sum(F.col("head").cast("int")).over(upto))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    found = marked.groupBy("doc_id", "part").agg(F.coalesce(F.max(F.when(F.col("head"), F.col("line"))), F.lit("")).alias("heading"), body.alias("body"), F.count_if(~F.col("head")).alias("n_lines"))
    return found.where("n_lines > 0")


def sentence_offsets(paragraphs: DataFrame) -> DataFrame:
    """Adds first_sentence, the running count of '. ' parts before a paragraph."""
    n = F.size(F.split("body", r"\. "))
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs.withColumn("first_sentence", F.coalesce(F.sum(n).over(before), F.lit(0)))


def bio_spans(tags: DataFrame, seq: str = "seq_id", pos: str = "pos", tag: str = "tag") -> DataFrame:
    """(seq_id, st, ed): each B with the run of I behind it, half open, by position in the sequence."""
    order = Window.partitionBy(seq).orderBy(pos)
    at = tags.select(seq, (F.row_number().over(order) - 1).alias("i"), tag)
    island = at.withColumn("run", F.sum(F.when(F.col(tag) == "I", 0).otherwise(1)).over(Window.partitionBy(seq).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy(seq, "run").agg(F.min("i").alias("st"), (F.max("i") + 1).alias("ed"), F.min_by(tag, "i").alias("kind"))
    return spans.where("kind = 'B'").select(seq, "st", "ed")


def info_units(docs: DataFrame, phrases: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sentences with their key phrases told apart as predicates and entities. phrases(sentences) adds key_phrases."""
    cut = docs.select("doc_id", F.posexplode(simple_sentences("text")).alias("sentence_idx", "text"))
    kinds = lambda kind: F.filter("key_phrases", lambda p: phrase_kind(p) == kind)
    return phrases(cut).withColumn("predicates", kinds("predicate")).withColumn("entities", kinds("entity")).drop("key_phrases")


def valid_triples(triples: DataFrame) -> DataFrame:
    full = [F.length(strip(F.coalesce(c, F.lit("")))) > 0 for c in ("subject", "predicate", "object")]
    return triples.where(full[0] & full[1] & full[2])


def resolve_triples(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """completeness of triples below 3: how many sentences of the paper their phrases name, two at most.
    triples: paper_id, triple_id, subject, predicate, object, completeness; terms: paper_id, sentence_idx, term."""
    parts = F.explode(F.array_distinct(F.transform(F.array("subject", "predicate", "object"), lambda p: F.lower(p))))
    open_ones = triples.where("completeness < 3").select("paper_id", "triple_id", parts.alias("term"))
    known = terms.select("paper_id", "sentence_idx", F.lower("term").alias("term")).distinct()
    seen = open_ones.join(known, ["paper_id", "term"]).groupBy("paper_id", "triple_id").agg(F.countDistinct("sentence_idx").alias("n"))
    new = F.when(F.col("completeness") >= 3, F.col("completeness")).otherwise(F.least(F.coalesce("n", F.lit(0)), F.lit(2)))
    return triples.join(seen, ["paper_id", "triple_id"], "left").withColumn("completeness", new.cast("int")).drop("n")


def triple_key(*cols) -> F.Column:
    return F.lower(F.concat_ws("||", *cols))


def evidence_lookup(wanted: DataFrame, triples: DataFrame, order_col: str = "triple_id") -> DataFrame:
    """wanted (subject, predicate, object) with the sentence of the last equal triple, whatever its case; null if there is none."""
    last = triples.groupBy(triple_key("subject", "predicate", "object").alias("key")).agg(F.max_by("sentence_idx", order_col).alias("sentence_idx"))
    return wanted.withColumn("key", triple_key("subject", "predicate", "object")).join(last, "key", "left").drop("key")


def unit_roll_up(units: DataFrame, paper_col: str = "paper_id", type_col: str = "unit_type") -> DataFrame:
    """Counts by paper and type, and by type over all papers (paper null, level 1), in one pass."""
    return units.rollup(type_col, paper_col).agg(F.count("*").alias("n"), F.grouping(paper_col).alias("level")).where(F.col(type_col).isNotNull())


def completeness_histogram(triples: DataFrame) -> DataFrame:
    return triples.groupBy("completeness").agg(F.count("*").alias("n")).withColumn("fully_resolved", F.col("completeness") >= 2)


def first_n(df: DataFrame, n: int, by: list[str], order: list) -> DataFrame:
    """The first n rows of each group: the fixed prefixes of reports."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= n).drop("nth")


def nested_sources(annotations: DataFrame, json_col: str = "json", id_col: str = "paper_id") -> DataFrame:
    """(paper_id, path, sentence) of all 'from sentence' leaves of nested JSON, at any depth. The one function that SQL can't
    express: an Arrow batch at a time, a small recursion per row."""
    import json

    import pandas as pd

    def leaves(node, path):
        if isinstance(node, dict):
            for key, value in node.items():
                if key == "from sentence" and isinstance(value, str):
                    yield "/".join(path), value
                else:
                    yield from leaves(value, [*path, key])
        elif isinstance(node, list):
            for value in node:
                yield from leaves(value, path)

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["json"]):
                try:
                    rows += [(i, p, s) for p, s in leaves(json.loads(text or "null"), [])]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=[id_col, "path", "sentence"])

    kind = annotations.schema[id_col].dataType.simpleString()
    return annotations.select(F.col(id_col).alias("id"), F.col(json_col).alias("json")).mapInPandas(run, f"{id_col} {kind}, path string, sentence string")


def triple_sources(annotations: DataFrame, json_col: str = "json", id_col: str = "paper_id") -> DataFrame:
    """(paper_id, subject, predicate, object, sentence): sentences of nested annotations that state a row's triple.

    A 'from sentence' entry speaks for the object it stands in. It states the triple if subject, predicate and object follow each other on
    a chain of phrases (keys, and strings at the end, lists looked into) that begins at the root and passes through that object.
    Sentences are stripped; a row gives each once. JSON that is null, broken or too deep for the parser gives no rows. An Arrow
    batch at a time, a small recursion per row."""
    import json

    import pandas as pd

    def chains(node, path):
        """All chains from path through node to its ends."""
        if isinstance(node, dict):
            below = [(k, v) for k, v in node.items() if k != "from sentence"]
            if not below:
                yield path
            for key, value in below:
                yield from chains(value, [*path, key])
        elif isinstance(node, list) and node:
            for value in node:
                yield from chains(value, path)
        else:
            yield [*path, node] if isinstance(node, str) else path

    def stating(node, path, triple):
        if isinstance(node, dict):
            said = node.get("from sentence")
            if isinstance(said, str) and any(c[i : i + 3] == triple for c in chains(node, path) for i in range(len(c) - 2)):
                yield said.strip()
            for key, value in node.items():
                yield from stating(value, [*path, key], triple)
        elif isinstance(node, list):
            for value in node:
                yield from stating(value, path, triple)

    def run(batches):
        for batch in batches:
            rows = []
            for i, text, *triple in zip(batch["id"], batch["json"], batch["subject"], batch["predicate"], batch["object"]):
                try:
                    rows += [(i, *triple, s) for s in dict.fromkeys(stating(json.loads(text or "null"), [], triple))]
                except (ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=[id_col, "subject", "predicate", "object", "sentence"])

    kind = annotations.schema[id_col].dataType.simpleString()
    rows = annotations.select(F.col(id_col).alias("id"), F.col(json_col).alias("json"), "subject", "predicate", "object")
    return rows.mapInPandas(run, f"{id_col} {kind}, subject string, predicate string, object string, sentence string")
