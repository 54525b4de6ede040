"""Landed search responses of scholarly APIs as uniform paper rows, and the links of papers.

Every mapping takes a table with one response body a row and returns the columns `keep` of the body's row, then title, authors,
year, abstract, doi, url, pdf_url, source_api, citation_count, is_oa. A body that is null, empty or no valid response gives
no rows; absent parts are empty strings, empty arrays, 0, false, or a null year. Of a body at most `most` results are taken, in
its order: the limit that the API has for one request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .readers import cached

OPENALEX = (
    "results array<struct<display_name: string, authorships: array<struct<author: struct<display_name: string>>>, publication_year: int, "
    "abstract: string, doi: string, id: string, cited_by_count: long, open_access: struct<is_oa: boolean, oa_url: string, pdf_url: string>>>"
)
CROSSREF = (
    "message struct<items: array<struct<title: array<string>, author: array<struct<given: string, family: string>>, "
    "`published-print`: struct<`date-parts`: array<array<int>>>, DOI: string, URL: string, `is-referenced-by-count`: long, "
    "open_access: struct<is_oa: boolean>, link: array<struct<`content-type`: string, URL: string>>>>>"
)
ARXIV = (
    "entry array<struct<id: string, title: string, summary: string, published: string, author: array<struct<name: string>>, "
    "link: array<struct<_href: string, _title: string>>>>"
)
RELATED = "papers array<struct<paperId: string, title: string, year: int>>"
#: Results of one request, as the APIs limit them, linked papers of one paper, recommended ones and how many
#: of these a request without a limit asks for.
MOST_OPENALEX, MOST_CROSSREF, MOST_ARXIV, MOST_LINKS, MOST_RELATED, RELATED_UNASKED = 200, 1000, 2000, 1000, 500, 20


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _names(people: Column, name) -> Column:
    return F.coalesce(F.transform(people, lambda a: _text(name(a))), F.array().cast("array<string>"))


def _results(pages: DataFrame, body: Column, results: str, most: int, keep: tuple[str, ...]) -> DataFrame:
    found = pages.select(*keep, body.alias("evidentia_body"))
    return found.select(*keep, F.explode(F.slice(f"evidentia_body.{results}", 1, most)).alias("r")).where("r IS NOT NULL")


def openalex(pages: DataFrame, body_col: str = "body", keep: tuple[str, ...] = (), most: int = MOST_OPENALEX) -> DataFrame:
    """Works of OpenAlex. The PDF is the open-access address, or else the PDF's."""
    oa = F.col("r.open_access")
    return _results(pages, F.from_json(body_col, OPENALEX), "results", most, keep).select(
        *keep, _text(F.col("r.display_name")).alias("title"), _names(F.col("r.authorships"), lambda a: a["author"]["display_name"]).alias("authors"),
        F.col("r.publication_year").alias("year"), _text(F.col("r.abstract")).alias("abstract"),
        F.replace(_text(F.col("r.doi")), F.lit("https://doi.org/"), F.lit("")).alias("doi"), _text(F.col("r.id")).alias("url"),
        _text(F.coalesce(F.nullif(oa["oa_url"], F.lit("")), oa["pdf_url"])).alias("pdf_url"), F.lit("openalex").alias("source_api"),
        F.coalesce("r.cited_by_count", F.lit(0)).alias("citation_count"), F.coalesce(oa["is_oa"], F.lit(False)).alias("is_oa"),
    )


def crossref(pages: DataFrame, body_col: str = "body", keep: tuple[str, ...] = (), most: int = MOST_CROSSREF) -> DataFrame:
    """Works of CrossRef, without abstracts. The PDF is the first link whose content type names one."""
    pdf = F.get(F.filter("r.link", lambda x: F.lower(x["content-type"]).contains("pdf")), F.lit(0))
    whole = lambda a: strip(F.concat(_text(a["given"]), F.lit(" "), _text(a["family"])))
    return _results(pages, F.from_json(body_col, CROSSREF), "message.items", most, keep).select(
        *keep, _text(F.get("r.title", F.lit(0))).alias("title"), _names(F.col("r.author"), whole).alias("authors"),
        F.get(F.get(F.col("r.published-print")["date-parts"], F.lit(0)), F.lit(0)).alias("year"), F.lit("").alias("abstract"),
        strip(_text(F.col("r.DOI"))).alias("doi"), _text(F.col("r.URL")).alias("url"), _text(pdf["URL"]).alias("pdf_url"),
        F.lit("crossref").alias("source_api"), F.coalesce("r.is-referenced-by-count", F.lit(0)).alias("citation_count"),
        F.coalesce("r.open_access.is_oa", F.lit(False)).alias("is_oa"),
    )


def arxiv(pages: DataFrame, body_col: str = "body", keep: tuple[str, ...] = (), most: int = MOST_ARXIV) -> DataFrame:
    """Entries of arXiv's Atom feed; all are open access. Without a link titled pdf, its address follows from the id."""
    feed = F.from_xml(F.col(body_col), ARXIV, {"ignoreNamespace": "true"})
    link = F.get(F.filter("r.link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    named = F.concat(F.lit("https://arxiv.org/pdf/"), F.element_at(F.split("r.id", "/abs/"), -1), F.lit(".pdf"))
    return _results(pages, feed, "entry", most, keep).select(
        *keep, strip(_text(F.col("r.title"))).alias("title"), _names(F.col("r.author"), lambda a: a["name"]).alias("authors"),
        F.substring("r.published", 1, 4).try_cast("int").alias("year"), strip(_text(F.col("r.summary"))).alias("abstract"),
        F.lit("").alias("doi"), _text(F.col("r.id")).alias("url"), _text(F.coalesce(F.nullif(link, F.lit("")), named)).alias("pdf_url"),
        F.lit("arxiv").alias("source_api"), F.lit(0).cast("long").alias("citation_count"), F.lit(True).alias("is_oa"),
    )


def paper_links(papers: DataFrame, relation: str = "references", most: int = MOST_LINKS) -> DataFrame:
    """(paper_id, nth, linked_id, title, year): the first `most` cited (references) or citing (citations) papers of paper rows, as
    readers.paper_records makes them, those without an id left out."""
    known = F.filter(relation, lambda r: r["paper_id"] != "")
    rows = papers.select("paper_id", F.posexplode(F.slice(known, 1, most)).alias("nth", "r"))
    return rows.select("paper_id", "nth", F.col("r.paper_id").alias("linked_id"), "r.title", "r.year")


def recommendations(requests: DataFrame, cache: DataFrame, most: int = MOST_RELATED) -> DataFrame:
    """(paper_id, nth, linked_id, title, year): papers recommended beside those of requests (paper_id, limit), in the order of the
    responses that a cache (key, body) has for them; requests without one, or with a broken one, give no rows. limit: how many are
    asked for, RELATED_UNASKED if null, `most` at most. Papers without an id are left out; equal requests count once."""
    limit = F.coalesce("limit", F.lit(RELATED_UNASKED))
    asked = requests.where("paper_id IS NOT NULL").select("paper_id", limit.alias("limit")).distinct()
    named = F.concat(F.col("paper_id").cast("string"), F.lit(":"), F.col("limit").cast("string"))
    found = cached(asked.select("*", F.lit("related").alias("method"), named.alias("query")), cache).where("body IS NOT NULL")
    known = F.filter(F.from_json("body", RELATED)["papers"], lambda r: F.coalesce(r["paperId"], F.lit("")) != "")
    cut = F.slice(known, F.lit(1), F.greatest(F.least("limit", F.lit(most)), F.lit(0)))
    rows = found.select("paper_id", F.posexplode(cut).alias("nth", "r"))
    return rows.select("paper_id", "nth", F.col("r.paperId").alias("linked_id"), _text(F.col("r.title")).alias("title"), F.coalesce("r.year", F.lit(0)).alias("year"))
