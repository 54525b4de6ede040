"""Reading documents, records and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cache_key, col, report_id, source_urls, strip

PAPER = (
    "paperId string, title string, abstract string, year int, authors variant, citationCount int, referenceCount int, venue string, url string, "
    "externalIds struct<DOI: string, ArXiv: string, CorpusId: string>, fieldsOfStudy array<string>, openAccessPdf struct<url: string>, "
    "references array<struct<paperId: string, title: string, year: int, citedPaper: struct<paperId: string, title: string, year: int>>>, "
    "citations array<struct<paperId: string, title: string, year: int, citingPaper: struct<paperId: string, title: string, year: int>>>"
)
READABLE = ("txt", "md", "pdf", "docx")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def read_documents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(doc_id, path, suffix, text) of the .txt, .md, .pdf and .docx files below a folder that hold visible text. A missing folder is an
    error. Undecodable bytes are dropped. PDF and DOCX need a parser (pypdf, python-docx); without it they give no text.
    Where files share a stem, the later paths get their path in the id, so ids don't collide."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    files = files.select("path", _suffix(F.col("path")).alias("suffix"), "content").where(F.col("suffix").isin(*READABLE))
    texts = files.mapInPandas(_decode, "path string, suffix string, text string").where(strip("text") != "")
    nth = F.row_number().over(Window.partitionBy(_stem(F.col("path"))).orderBy("path"))
    stem = _stem(F.col("path"))
    return texts.withColumn("nth", nth).select(F.when(F.col("nth") == 1, stem).otherwise(F.concat(stem, F.lit("~"), F.substring(F.md5(F.col("path").cast("binary")), 1, 8))).alias("doc_id"), "path", "suffix", "text")


def _decode(batches):
    import pandas as pd

    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "suffix": batch["suffix"], "text": [_text_of(s, c) for s, c in zip(batch["suffix"], batch["content"])]})


def _text_of(suffix: str, content: bytes) -> str:
    import io

    if suffix in ("txt", "md"):
        return bytes(content).decode("utf-8", "ignore")
    try:
        if suffix == "pdf":
            from pypdf import PdfReader

            return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)
        from docx import Document

        return "\n".join(p.text for p in Document(io.BytesIO(content)).paragraphs)
    except Exception:  # an unreadable file, or no parser: no text
        return ""


def file_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, suffix): one path for each stem, the first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    named = files.select(_stem(F.col("path")).alias("doc_id"), "path", _suffix(F.col("path")).alias("suffix"))
    return named.groupBy("doc_id").agg(F.min(F.struct("path", "suffix")).alias("f")).select("doc_id", "f.path", "f.suffix")


def suffix_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("suffix").agg(F.count("*").alias("n"))


def paper_records(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Landed API records (JSON text) as uniform paper rows: names of authors whether objects or strings, cited and citing papers
    unwrapped, identifiers and the PDF address lifted; absent parts null-safe."""
    p = raw.select(F.from_json(json_col, PAPER).alias("p")).select("p.*")
    name = F.filter(F.transform(F.coalesce(F.try_variant_get("authors", "$", "array<variant>"), F.array().cast("array<variant>")), lambda a: F.coalesce(F.try_variant_get(a, "$.name", "string"), F.try_variant_get(a, "$", "string"))), lambda n: n.isNotNull() & ~n.startswith("{"))
    inner = lambda c, key: F.transform(F.coalesce(c, F.array().cast(p.schema[c].dataType)), lambda r: F.struct(
        F.coalesce(r[key]["paperId"], r["paperId"], F.lit("")).alias("paper_id"), F.coalesce(r[key]["title"], r["title"], F.lit("")).alias("title"), F.coalesce(r[key]["year"], r["year"], F.lit(0)).alias("year")))
    text = lambda c: F.coalesce(col(c), F.lit(""))
    return p.select(
        text("paperId").alias("paper_id"), text("title").alias("title"), text("abstract").alias("abstract"), F.coalesce("year", F.lit(0)).alias("year"), name.alias("authors"),
        F.coalesce("citationCount", F.lit(0)).alias("citation_count"), F.coalesce("referenceCount", F.lit(0)).alias("reference_count"), text("venue").alias("venue"), text("url").alias("url"),
        text("openAccessPdf.url").alias("pdf_url"), text("externalIds.DOI").alias("doi"), text("externalIds.ArXiv").alias("arxiv_id"), text("externalIds.CorpusId").alias("corpus_id"),
        F.coalesce("fieldsOfStudy", F.array().cast("array<string>")).alias("fields_of_study"), inner("references", "citedPaper").alias("references"), inner("citations", "citingPaper").alias("citations"),
    )


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (method, query) with the body a cache table (key, body) has for them, null where a call is still due."""
    return requests.withColumn("key", cache_key("method", "query")).join(cache.select("key", "body"), "key", "left")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.round(F.sum(F.octet_length("body")) / 1048576, 2).alias("size_mb"))


def download_url(df: DataFrame) -> DataFrame:
    """Papers with an address to fetch: the PDF's, or else the first alternative."""
    url = F.coalesce(F.nullif(F.col("pdf_url"), F.lit("")), F.get("pdf_alternatives", F.lit(0)))
    return df.withColumn("download_url", url).where(F.coalesce("download_url", F.lit("")) != "")


def report_chunks(reports: DataFrame, most: int = 8, markdown_col: str = "markdown", query_col: str = "query") -> DataFrame:
    """Markdown web reports cut at headings of level 1 to 4: document_id, chunk_id, section_header, title, text, sources. Bodies
    under 30 characters are dropped, the first `most` kept, longer ones than 2500 cut at their last newline before that. A
    report without headings is one section."""
    md = strip(F.col(markdown_col))
    form = r"(?m)^(#{1,4})[ \t]+(.*)$"
    heads = F.regexp_extract_all(md, F.lit(form), F.lit(0))
    bodies = F.split(md, form, -1)
    sections = F.transform(heads, lambda h, i: F.struct(strip(h).alias("header"), strip(F.get(bodies, i + 1)).alias("body")))
    sections = F.slice(F.filter(sections, lambda s: F.char_length(s["body"]) >= 30), 1, most)
    whole = F.when(md != "", F.array(F.struct(F.lit("Firecrawl report").alias("header"), md.alias("body"))))
    cut = reports.select(F.col(query_col).alias("query"), report_id(query_col).alias("document_id"), source_urls(md).alias("sources"), F.posexplode(F.when(F.size(heads) > 0, sections).otherwise(whole)).alias("i", "s"))
    body = F.substring("s.body", 1, 2500)
    short = F.when(F.char_length("s.body") <= 2500, F.col("s.body")).otherwise(F.regexp_replace(body, r"\n[^\n]*$", ""))
    header = F.regexp_replace("s.header", r"^(#+)\s+", "$1 ")
    return cut.select(
        "document_id", F.concat("document_id", F.lit("::chunk"), (F.col("i") + 1).cast("string")).alias("chunk_id"), header.alias("section_header"),
        strip(F.replace(header, F.lit("#"), F.lit(""))).alias("title"), short.alias("text"), "sources",
    )


def top_report(papers: DataFrame, n: int = 30) -> DataFrame:
    """The n most cited papers, then the most relevant, as lines."""
    top = papers.orderBy(F.desc("citation_count"), F.desc("relevance_score"), "title").limit(n)
    return top.select("title", F.format_string("- %s (%d) — %d citations", "title", "year", "citation_count").alias("line"))
