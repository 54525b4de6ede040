"""Triples, key phrases and information units of texts without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, VERB_STEMS, col, phrase_kind, strip
from ..functions.vectors import let
from .symbolic import lines, paragraphs, sentence_offsets

#: A token: a word, or a mark that no phrase reaches across.
TOKEN = r"[\p{L}\p{N}%][\p{L}\p{N}%'-]*|[,;:()\[\].!?]"
#: What a heading says about the sentences under it; the first that fits, else Contribution.
UNIT_HEADINGS = {
    "Results": "result|experiment|evaluation|analysis", "Positioning": "related|background|prior", "Definition": "definition|preliminar|notation",
    "Support": "proof|theorem|lemma|discussion", "Task": "introduction|problem|task",
}


def verb_forms(stems: list[str] = VERB_STEMS) -> str:
    """A pattern of whole lower-case words: the regular forms of verbs."""
    forms = [s[:-1] + "(e|es|ed|ing)" if s.endswith("e") else s[:-1] + "(y|ies|ied|ying)" if s[-1] == "y" and s[-2] not in "aeiou" else s + "(s|es|ed|ing)?" for s in stems]
    return f"^({'|'.join(forms)})$"


def tagged(text, verbs: str | None = None, function_words: list[str] = STOP_WORDS) -> Column:
    """array<struct<word, kind>>: the tokens of a text, of kind V (matches verbs), D (a function word), B (a mark) or N."""
    low = lambda w: F.lower(w)
    kind = lambda w: (
        F.when(F.rlike(w, F.lit(r"^[,;:()\[\].!?]$")), "B").when(F.rlike(low(w), F.lit(verbs or verb_forms())), "V").when(low(w).isin(*function_words), "D").otherwise("N")
    )
    return F.transform(F.regexp_extract_all(col(text), F.lit(TOKEN), F.lit(0)), lambda w: F.struct(w.alias("word"), kind(w).alias("kind")))


def triple_spans(kinds) -> Column:
    """array<struct<s0,s1,v0,v1,o0,o1>>: where in an array of kinds N+ D* V+ D* N+ stands, half open, leftmost first, without overlap.

    A finite-state chunker as one fold. States: 0 nothing, 1 in a subject, 2 function words behind it, 3 in the predicate, 4
    function words behind it, 5 in the object. What ends an object emits the triple; what fits nowhere starts over."""

    def step(s: Column, kind: Column) -> Column:
        noun, verb, word, at, phase = kind == "N", kind == "V", kind == "D", s["at"], s["phase"]
        begins = noun & phase.isin(0, 2)
        new = (
            F.when(noun, F.when(phase <= 2, 1).otherwise(5))
            .when(verb, F.when(phase.isin(1, 2, 3), 3).otherwise(0))
            .when(word, F.when(phase.isin(1, 2), 2).when(phase.isin(3, 4), 4).otherwise(0))
            .otherwise(0)
        )
        ended = (phase == 5) & ~noun
        span = F.struct(*[s[c].alias(c) for c in ("s0", "s1", "v0", "v1", "o0", "o1")])
        return F.struct(
            (at + 1).alias("at"), new.cast("int").alias("phase"),
            F.when(begins, at).otherwise(s["s0"]).alias("s0"), F.when(noun & (phase <= 2), at + 1).otherwise(s["s1"]).alias("s1"),
            F.when(verb & phase.isin(1, 2), at).otherwise(s["v0"]).alias("v0"), F.when(verb & phase.isin(1, 2, 3), at + 1).otherwise(s["v1"]).alias("v1"),
            F.when(noun & phase.isin(3, 4), at).otherwise(s["o0"]).alias("o0"), F.when(noun & (phase >= 3), at + 1).otherwise(s["o1"]).alias("o1"),
            F.when(ended, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"),
        )

    zero = F.lit(0)
    start = F.struct(
        zero.alias("at"), zero.alias("phase"), *[zero.alias(c) for c in ("s0", "s1", "v0", "v1", "o0", "o1")],
        F.array().cast("array<struct<s0:int,s1:int,v0:int,v1:int,o0:int,o1:int>>").alias("out"),
    )
    return F.aggregate(F.concat(col(kinds), F.array(F.lit("B"))), start, step, lambda s: s["out"])


def triples_of(text, verbs: str | None = None, function_words: list[str] = STOP_WORDS) -> Column:
    """array<struct<subject, predicate, object>> of a sentence."""
    part = lambda t, a, b: F.array_join(F.transform(F.slice(t, a + 1, b - a), lambda x: x["word"]), " ")

    def cut(t: Column) -> Column:
        spans = triple_spans(F.transform(t, lambda x: x["kind"]))
        return F.transform(spans, lambda s: F.struct(part(t, s["s0"], s["s1"]).alias("subject"), part(t, s["v0"], s["v1"]).alias("predicate"), part(t, s["o0"], s["o1"]).alias("object")))

    return let(tagged(text, verbs, function_words), cut)


def paragraph_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, heading, sentence_idx, text): the parts between '. ' of every paragraph, numbered through the document."""
    whole = sentence_offsets(paragraphs(lines(docs, id_col, text_col)))
    cut = whole.select("doc_id", "heading", "first_sentence", F.posexplode(F.split("body", r"\. ")).alias("i", "text"))
    return cut.select("doc_id", "heading", (F.col("first_sentence") + F.col("i")).cast("int").alias("sentence_idx"), strip("text").alias("text")).where("text <> ''")


def unit_type(heading) -> Column:
    out = F.lit("Contribution")
    for kind, form in reversed(UNIT_HEADINGS.items()):
        out = F.when(F.rlike(F.lower(F.coalesce(col(heading), F.lit(""))), F.lit(form)), F.lit(kind)).otherwise(out)
    return out


def extract_triples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verbs: str | None = None, function_words: list[str] = STOP_WORDS) -> DataFrame:
    """(paper_id, sentence_idx, nth, subject, predicate, object, info_unit, completeness): the triples that every sentence states, the
    default where no model extracts them. Their parts stand in one sentence, so they are complete (3). Texts without
    sentences, null ones among them, state none."""
    cut = paragraph_sentences(docs, id_col, text_col)
    found = cut.select("doc_id", "heading", "sentence_idx", F.posexplode(triples_of("text", verbs, function_words)).alias("nth", "t"))
    return found.select(F.col("doc_id").alias("paper_id"), "sentence_idx", "nth", "t.*", unit_type("heading").alias("info_unit"), F.lit(3).alias("completeness"))


def phrases_of(text, function_words: list[str] = STOP_WORDS) -> Column:
    """array<array<string>>: the runs of lower-cased words between function words and marks."""
    words = F.transform(tagged(text, "^$", function_words), lambda t: F.when(t["kind"] == "N", F.lower(t["word"])).otherwise("|"))
    runs = F.filter(F.transform(F.split(F.array_join(words, " "), r"\|"), lambda r: F.trim(r)), lambda r: r != "")
    return F.transform(runs, lambda r: F.split(r, " "))


def sentence_phrases(sentences: DataFrame, most: int = 5, longest: int = 4, function_words: list[str] = STOP_WORDS, dealt: bool = False) -> DataFrame:
    """(doc_id, sentence_idx, key_phrases): the `most` best of every sentence (doc_id, sentence_idx, text) that has any, best first, ties in their order.

    A phrase is a run of up to `longest` words between function words and marks. Words of a document that stand in one phrase
    are neighbours in a graph; a word's score is its degree there, itself included, over its frequency, a phrase's the sum of its
    words'. A document's words are counted where they are, by windows: the sentences are dealt by document once (not at all, if they are
    `dealt`, as paragraph_sentences' are), and each phrase's text goes with one of its words. Repeated (doc_id, sentence_idx) count as one sentence, rows without a doc_id as none."""
    texts = sentences.select("doc_id", "sentence_idx", F.posexplode(phrases_of("text", function_words)).alias("nth", "words"))
    cut = texts.where((F.size("words") <= longest) & F.col("doc_id").isNotNull())
    cut = (cut if dealt else cut.repartition("doc_id")).withColumn("phrase", F.array_join("words", " "))
    words = cut.select("doc_id", "sentence_idx", "nth", F.size("words").alias("n"), F.xxhash64("phrase").alias("which"), "phrase", F.posexplode("words").alias("at", "word"))
    words = words.withColumn("phrase", F.when(F.col("at") == 0, F.col("phrase"))).drop("at")
    same = Window.partitionBy("doc_id", "word")
    words = words.withColumn("score", F.sum("n").over(same) / F.count("*").over(same))
    found = words.groupBy("doc_id", "sentence_idx", "nth", "which").agg(F.max("phrase").alias("phrase"), F.round(F.sum("score"), 9).alias("score"))
    once = found.groupBy("doc_id", "sentence_idx", "phrase").agg(F.min("nth").alias("nth"), F.max("score").alias("score"))
    order = Window.partitionBy("doc_id", "sentence_idx").orderBy(F.desc("score"), "nth")
    best = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    rows = best.groupBy("doc_id", "sentence_idx").agg(F.sort_array(F.collect_list(F.struct("r", "phrase"))).alias("rows"))
    return rows.select("doc_id", "sentence_idx", F.transform("rows", lambda r: r["phrase"]).alias("key_phrases"))


def key_phrases(sentences: DataFrame, most: int = 5, longest: int = 4, function_words: list[str] = STOP_WORDS) -> DataFrame:
    """sentences (doc_id, sentence_idx, text, ...) with key_phrases (sentence_phrases); sentences without phrases have none."""
    told = sentence_phrases(sentences, most, longest, function_words)
    none = F.array().cast("array<string>")
    return sentences.join(told, ["doc_id", "sentence_idx"], "left").withColumn("key_phrases", F.coalesce("key_phrases", none))


def info_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=key_phrases) -> DataFrame:
    """(paper_id, sentence_idx, text, main_heading, unit_type, predicates, entities): sentences of more than 10 characters as information
    units, typed by their heading, their key phrases told apart; phrases(sentences) adds key_phrases."""
    cut = paragraph_sentences(docs, id_col, text_col).where(F.char_length("text") > 10)
    kinds = lambda kind: F.filter("key_phrases", lambda p: phrase_kind(p) == kind)
    return phrases(cut).select(
        F.col("doc_id").alias("paper_id"), "sentence_idx", "text", F.col("heading").alias("main_heading"), unit_type("heading").alias("unit_type"),
        kinds("predicate").alias("predicates"), kinds("entity").alias("entities"),
    )


def unit_terms(units: DataFrame) -> DataFrame:
    """(paper_id, sentence_idx, term): the phrases of information units, by which triples are resolved across sentences."""
    return units.select("paper_id", "sentence_idx", F.explode(F.concat("predicates", "entities")).alias("term"))
