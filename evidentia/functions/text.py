"""Text functions: Column in, Column out, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
STOP_WORDS = "the a an is are was were in on at to for of with and or but this that it".split()
TITLE_STOP_WORDS = "the a an and or of in on at to for with by from as is are was were using based via".split()
MAIN_HEADINGS = [
    "abstract", "introduction", "related work", "background", "method", "approach", "model", "architecture",
    "experiment", "evaluation", "results", "analysis", "discussion", "conclusion", "future work",
    "theorem", "proof", "lemma", "definition", "implementation", "application", "dataset",
]
VERB_STEMS = "achieve use propose show demonstrate outperform improve reduce increase employ adopt apply".split()
QUERY_EXPANSION = {
    "deep search": "deep search retrieval augmented generation iterative",
    "neural network": "neural network deep learning",
    "machine learning": "machine learning artificial intelligence",
}
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *[f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)]]
SPACE = r"[\t\n\x0B\f\r ]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    return F.regexp_replace(col(x), rf"^{SPACE}+|{SPACE}+$", "")


def words(x) -> Column:
    """Split on white space; no empty parts."""
    return F.filter(F.split(col(x), rf"{SPACE}+"), lambda w: w != "")


def chunk_spans(text, size: int = 1000, overlap: int = 100) -> Column:
    """Spans [start, end) of overlapping windows, as array<struct<start,end>>.

    A window that isn't the last ends after the last blank line in it, else after the last '. ', else after the last
    newline, if that lies beyond half the size; the next one starts `overlap` before its end. One fold over as many
    steps as the least advance can need, over slices of the text; positions count code points. Null and empty text have none.
    """
    if size // 2 <= overlap:
        raise ValueError("half the size must exceed the overlap, else a window may not advance")
    text = col(text)
    least = size // 2 + 1 - overlap

    def after_last(window: Column, sep: str) -> Column:
        at = F.locate(sep[::-1], F.reverse(window))
        where = F.char_length(window) - at + 1 - len(sep)  # from 0
        return F.when((at > 0) & (where > size // 2), where + len(sep))

    def fold(slices: Column) -> Column:
        """Over slices of `size` characters: a window lies in two of them, so a step's work doesn't grow with the text."""

        def step(s: Column, _: Column) -> Column:
            first = F.floor(s["at"] / size).cast("int")
            two = F.concat(F.get(slices, first), F.coalesce(F.get(slices, first + 1), F.lit("")))
            window = F.substr(two, s["at"] % size + 1, F.lit(size))
            cut = s["at"] + F.coalesce(after_last(window, "\n\n"), after_last(window, ". "), after_last(window, "\n"), F.lit(size))
            end = F.when(s["at"] + size >= s["n"], s["n"]).otherwise(cut)
            span = F.struct(s["at"].alias("start"), end.alias("end"))
            at = F.when(end >= s["n"], s["n"]).otherwise(end - overlap)
            more = F.struct(at.alias("at"), s["n"].alias("n"), F.concat(s["spans"], F.array(span)).alias("spans"))
            return F.when(s["at"] < s["n"], more).otherwise(s)

        n = (F.size(slices) - 1) * size + F.char_length(F.element_at(slices, -1))
        none = F.array().cast("array<struct<start:int,end:int>>")
        start = F.struct(F.lit(0).alias("at"), n.cast("int").alias("n"), none.alias("spans"))
        steps = F.sequence(F.lit(0), F.ceil(n / least).cast("int"))
        return F.when(F.size(slices) > 0, F.aggregate(steps, start, step, lambda s: s["spans"])).otherwise(none)

    slices = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.get(F.transform(F.array(slices), fold), F.lit(0))


def sentences(text) -> Column:
    """Parts after . ! or ? and white space, stripped, without empty ones."""
    parts = F.split(col(text), rf"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def simple_sentences(text) -> Column:
    """Parts between '. ' of more than 10 characters."""
    return F.filter(F.transform(F.split(col(text), r"\. "), strip), lambda s: F.char_length(s) > 10)


def has_citation(text) -> Column:
    return F.rlike(col(text), F.lit(r"\[[0-9]+\]|\[[a-zA-Z0-9_-]+\]"))


def citation_ids(text) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"\[(.*?)\]"), F.lit(1))


def cited_works(text, doc_id) -> Column:
    """[Author2020], [Author et al. 2020] as they are; [12] as a reference of its document."""
    found = F.regexp_extract_all(col(text), F.lit(r"\[([A-Z][a-z]+(?:\s+et\s+al\.?)?\s*(?:[0-9]{4})?|[0-9]{1,3})\]"), F.lit(1))
    return F.transform(found, lambda k: F.when(F.rlike(k, F.lit("^[0-9]+$")), F.concat(col(doc_id), F.lit("_ref_"), k)).otherwise(k))


def _capital(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return (F.upper(first) == first) & (F.lower(first) != first)


def is_heading(line) -> Column:
    """Short numbered, upper-case or mostly capitalised lines."""
    line = strip(line)
    w = words(line)
    upper = (F.upper(line) == line) & (F.lower(line) != line)
    numbered = F.rlike(line, F.lit(r"^([0-9]+(\.[0-9]+)*[.)]?\s+\w|[IVX]+[.)]\s+\w)"))
    first, open_end = _capital(F.get(w, F.lit(0))), ~F.rlike(line, F.lit(r"[.,;:!?]$"))
    capitals = F.size(F.filter(w, _capital))
    titled = (F.size(w) >= 2) & first & (capitals >= F.greatest(F.size(w) * 0.5, F.lit(1.0))) & open_end
    short = (F.size(w) <= 3) & (F.char_length(line) > 3) & open_end & (upper | first)
    seen = F.coalesce(numbered | (upper & (F.size(w) >= 2)) | titled | short, F.lit(False))
    return F.coalesce((line != "") & (F.char_length(line) <= 100), F.lit(False)) & seen


def is_main_heading(line) -> Column:
    low = F.lower(strip(line))
    known = F.exists(F.array(*map(F.lit, MAIN_HEADINGS)), lambda k: F.contains(low, k))
    return (known & is_heading(line)) | F.rlike(strip(line), F.lit(r"^([0-9]+[.)]\s|[IVX]+[.)]\s)"))


def title_tokens(title) -> Column:
    low = F.lower(title)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        low = F.replace(low, F.lit(entity), F.lit(char))
    found = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(found, lambda t: (F.char_length(t) > 2) & ~t.isin(*TITLE_STOP_WORDS))


def query_terms(query) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(col(query)), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(found, lambda t: F.char_length(t) > 2)


def expand_query(query) -> Column:
    query, out = col(query), F.lit(None).cast("string")
    for generic, text in reversed(QUERY_EXPANSION.items()):
        out = F.when(F.contains(F.lower(query), F.lit(generic)), F.lit(text)).otherwise(out)
    return F.when(F.size(words(query)) < 4, F.coalesce(out, query)).otherwise(query)


def fingerprint(doi, title) -> Column:
    doi = col(doi)
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("doi:"), strip(F.lower(doi)))).otherwise(F.substring(strip(F.lower(col(title))), 1, 80))


def theme_id(query) -> Column:
    q = strip(F.coalesce(col(query), F.lit("")))
    q = F.when(q == "", F.lit("empty_query")).otherwise(q)
    slug = F.substring(F.lower(F.regexp_replace(F.regexp_replace(q, "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", "")), 1, 48)
    return F.concat(F.when(slug == "", F.lit("theme")).otherwise(slug), F.lit("_"), F.substring(F.sha2(q, 256), 1, 16))


def cache_key(method, query) -> Column:
    return F.md5(F.concat(col(method), F.lit(":"), col(query)).cast("binary"))


def report_id(query) -> Column:
    return F.concat(F.lit("firecrawl://"), F.substring(F.sha2(col(query), 256), 1, 16))


def safe_filename(name, most: int = 120) -> Column:
    safe = F.regexp_replace(F.regexp_replace(col(name), r'[<>:"/\\|?*\x00-\x1f]', "_"), "[_ ]+", "_")
    safe = F.regexp_replace(safe, r"^[. ]+|[. ]+$", "")
    return F.substring(F.when(F.upper(safe).isin(*RESERVED_NAMES), F.concat(F.lit("_"), safe)).otherwise(safe), 1, most)


def safe_relname(name) -> Column:
    p = strip(F.coalesce(col(name), F.lit("")))
    return F.substring(F.regexp_replace(F.when(p == "", F.lit("unknown")).otherwise(p), "[^a-zA-Z0-9._-]+", "_"), 1, 180)


def parse_gaps(text, most: int = 2) -> Column:
    """What a critic's answer lists: nothing, 'GAPS: a | b', or its longer lines."""
    text = col(text)
    listed = F.substr(text, F.locate("GAPS:", text) + 5)
    listed = F.filter(F.transform(F.split(listed, r"\|"), strip), lambda g: g != "")
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    lines = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, "^[- ]+|[- ]+$", "")), lambda x: (F.char_length(x) > 20) & (F.char_length(x) < 200))
    none = F.array().cast("array<string>")
    return F.when(F.contains(F.upper(text), F.lit("NO GAPS")), none).when(F.contains(text, F.lit("GAPS:")), listed).otherwise(F.slice(lines, 1, most))


def parse_outline_line(line) -> Column:
    """'1. Title: description' as a struct, null if the line has no such form."""
    line, form = strip(line), r"^(?:[0-9]+[.\-]\s*)?(.+?)[:\-–]\s*(.*)"
    return F.when(F.rlike(line, F.lit(form)), F.struct(strip(F.regexp_extract(line, form, 1)).alias("title"), strip(F.regexp_extract(line, form, 2)).alias("description")))


def parse_paper_tag(text) -> Column:
    """'[Paper]T' as (paper, tag); anything else is a paper with tag M."""
    text, form = col(text), r"^\[(.*?)\]([TEMA])"
    return F.when(F.rlike(text, F.lit(form)), F.struct(F.regexp_extract(text, form, 1).alias("paper"), F.regexp_extract(text, form, 2).alias("tag"))).otherwise(
        F.struct(text.alias("paper"), F.lit("M").alias("tag"))
    )


def parse_decision(text) -> Column:
    """SEARCH with a follow-up query, ANSWER, or what short agreement means; else SEARCH for more details."""
    text, form = strip(text), r"(?i)SEARCH[:\s]*(.+)"
    follow = F.regexp_replace(strip(F.regexp_extract(text, form, 1)), "^[\"']+|[\"']+$", "")
    agrees = F.exists(F.array(*map(F.lit, ("yes", "enough", "covered", "sufficient"))), lambda w: F.contains(F.lower(text), w))
    answer = F.contains(F.upper(text), F.lit("ANSWER")) | ((F.char_length(text) < 50) & agrees)
    make = lambda action, q: F.struct(F.lit(action).alias("action"), q.alias("follow_up"))
    return (
        F.when(F.rlike(text, F.lit(form)), make("SEARCH", follow))
        .when(answer, make("ANSWER", F.lit(None).cast("string")))
        .otherwise(make("SEARCH", F.lit("more details")))
    )


def json_answer(text) -> Column:
    """A model's JSON without code fences, as VARIANT; else what lies between the outer braces; else null."""
    text = strip(text)
    body = strip(F.regexp_replace(F.regexp_replace(text, "^```(json)?", ""), "```$", ""))
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_extract(body, r"(\{[\s\S]*\})", 1)))


def marked_response(text) -> Column:
    """What stands between [Response_Start] and [Response_End], null if not marked."""
    form = r"(?s)\[Response_Start\](.*?)\[Response_End\]"
    return F.when(F.rlike(col(text), F.lit(form)), strip(F.regexp_extract(col(text), form, 1)))


def says_yes(text) -> Column:
    return F.contains(F.lower(F.substring(col(text), 1, 50)), F.lit("yes"))


def format_passages(passages) -> Column:
    """array<struct<title,text>> as numbered lines."""
    lines = F.transform(passages, lambda p, i: F.concat(F.lit("["), i.cast("string"), F.lit("] Title: "), p["title"], F.lit(" Text: "), F.substring(p["text"], 1, 300)))
    return F.array_join(lines, "\n")


def phrase_kind(phrase) -> Column:
    """predicate if a phrase holds a verb stem, else entity."""
    low = F.lower(col(phrase))
    return F.when(F.exists(F.array(*map(F.lit, VERB_STEMS)), lambda v: F.contains(low, v)), "predicate").otherwise("entity")


def source_urls(markdown) -> Column:
    """Targets of markdown links, or else bare URLs, each once in order."""
    linked = F.transform(F.regexp_extract_all(col(markdown), F.lit(r"\[[^\]]*\]\((https?://[^)\s]+)\)"), F.lit(1)), strip)
    bare = F.regexp_extract_all(col(markdown), F.lit(r"(https?://[^\s)\]]+)"), F.lit(1))
    return F.array_distinct(F.when(F.size(linked) > 0, linked).otherwise(bare))


def numbers(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"[0-9]+\.?[0-9]*"), F.lit(0)))
