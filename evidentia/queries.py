"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scores, text, vectors
from .operators import attribution, dedup, extraction, graph, postings, retrieval, selection, symbolic, tree
from .plans import leaves, models, reasoning, synthesis
from .sources import papers as paper_sources
from .sources import readers, sinks

QUERIES, ORACLES = {}, {}
#: Keywords that occur in the invented prose.
KEYWORDS = {"T": ["thble", "thing", "thanea"], "E": ["thtion", "erble", "antion"], "M": ["attion", "ering", "ontion"], "A": ["ertion", "oning", "retion"]}
STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TITLE_STOP = ", ".join(f"'{w}'" for w in text.TITLE_STOP_WORDS)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked(spark, sf_dir) -> DataFrame:
    """documents with a citation mark behind every third text."""
    mark = F.concat(F.lit(" ["), (F.col("doc_id") % 7).cast("string"), F.lit("]"))
    return table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", mark)).otherwise(F.col("text")))


MARKED = "m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' [' || (doc_id % 7)::VARCHAR || ']' ELSE text END AS text FROM documents)"
STRIP = lambda x: f"regexp_replace({x}, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')"
CHUNKS = rf"""
b AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) ELSE text END AS t FROM documents),
c AS (
  SELECT doc_id, 0 AS s, 0 AS e, -1 AS nxt FROM b WHERE false
  UNION ALL SELECT doc_id, 0, 0, 0 FROM b WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, nxt, e2, CASE WHEN e2 >= n THEN NULL ELSE e2 - 100 END FROM (
    SELECT doc_id, nxt, n, CASE WHEN nxt + 1000 >= n THEN n WHEN p1 > 500 THEN nxt + p1 + 2 WHEN p2 > 500 THEN nxt + p2 + 2 WHEN p3 > 500 THEN nxt + p3 + 1 ELSE nxt + 1000 END AS e2 FROM (
      SELECT c.doc_id, c.nxt, length(b.t) AS n,
        CASE WHEN strpos(reverse(w), chr(10) || chr(10)) > 0 THEN length(w) - strpos(reverse(w), chr(10) || chr(10)) - 1 ELSE -1 END AS p1,
        CASE WHEN strpos(reverse(w), ' .') > 0 THEN length(w) - strpos(reverse(w), ' .') - 1 ELSE -1 END AS p2,
        CASE WHEN strpos(reverse(w), chr(10)) > 0 THEN length(w) - strpos(reverse(w), chr(10)) ELSE -1 END AS p3
      FROM c JOIN b USING (doc_id), LATERAL (SELECT substr(b.t, c.nxt + 1, 1000) AS w) WHERE c.nxt IS NOT NULL AND c.nxt < length(b.t))))"""
CHUNK_ROWS = rf"SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS chunk_ord, x AS text, s::INT AS start_pos, e::INT AS end_pos FROM (SELECT c.*, {STRIP('substr(b.t, s + 1, e - s)')} AS x FROM c JOIN b USING (doc_id) WHERE e > s) WHERE x <> ''"


def broken(spark, sf_dir) -> DataFrame:
    """documents with blank lines in every third text."""
    lines = F.replace("text", F.lit(".\n"), F.lit(".\n\n"))
    return table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, lines).otherwise(F.col("text")))


@query("chunk_documents", f"WITH RECURSIVE {CHUNKS} SELECT document_id, chunk_ord, start_pos, end_pos, md5(text) AS text_md5 FROM ({CHUNK_ROWS})")
def chunk_documents(spark, sf_dir):
    return retrieval.chunks(broken(spark, sf_dir)).select("document_id", "chunk_ord", "start_pos", "end_pos", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("chunk_stats", f"WITH RECURSIVE {CHUNKS}, r AS ({CHUNK_ROWS}) SELECT document_id, count(*) AS n_chunks, md5(arg_min(text, chunk_ord)) AS first_md5, md5(substr(string_agg(text, ' ' ORDER BY chunk_ord), 1, 5000)) AS source_md5 FROM r GROUP BY 1")
def chunk_stats(spark, sf_dir):
    made = retrieval.chunks(broken(spark, sf_dir)).select("document_id", "chunk_ord", "text")
    first, whole = retrieval.first_chunks(made), retrieval.source_texts(made)
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    return first.join(whole, "document_id").select("document_id", "n_chunks", md5("text").alias("first_md5"), md5("source_text").alias("source_md5"))


SENTENCES = r"s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, x FROM (SELECT doc_id, i, " + STRIP("p[i]") + r" AS x FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[\t\n\x0B\f\r ]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM m))) WHERE x <> '')"


@query("sentence_split", f"WITH {MARKED}, {SENTENCES} SELECT doc_id, n::INT AS sentence_ord, md5(x) AS text_md5 FROM s")
def sentence_split(spark, sf_dir):
    cut = marked(spark, sf_dir).select("doc_id", F.posexplode(text.sentences("text")).alias("sentence_ord", "s"))
    return cut.select("doc_id", "sentence_ord", F.md5(F.col("s").cast("binary")).alias("text_md5"))


@query("citation_coverage", rf"WITH {MARKED}, {SENTENCES} SELECT doc_id, count(*) AS sentences, count(*) FILTER (c) AS cited, round(avg(c::INT::DOUBLE), 2) AS coverage, count(*) FILTER (c) AS verified FROM (SELECT doc_id, regexp_matches(x, '\[[0-9]+\]|\[[a-zA-Z0-9_-]+\]') AS c FROM s WHERE length(x) >= 5) GROUP BY 1")
def citation_coverage(spark, sf_dir):
    return attribution.citation_coverage(attribution.attribute(marked(spark, sf_dir)), "doc_id")


@query("citation_keys", r"WITH " + MARKED + r" SELECT doc_id, doc_id::VARCHAR || '_ref_' || k AS cited FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\[([0-9]{1,3})\]', 1)) AS k FROM m) GROUP BY ALL")
def citation_keys(spark, sf_dir):
    edges = graph.text_edges(marked(spark, sf_dir))
    return edges.select(F.col("src").cast("long").alias("doc_id"), F.col("dst").alias("cited"))


HEADED = r"""
l AS (SELECT doc_id, i - 1 AS line_no, CASE WHEN i % 4 = 0 THEN (i // 4)::VARCHAR || '. Section Heading' ELSE p[i] END AS raw FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
t AS (SELECT doc_id, line_no, """ + STRIP("raw") + r""" AS line FROM l),
w AS (SELECT *, list_filter(regexp_split_to_array(line, '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS ws FROM t WHERE line <> ''),
k AS (SELECT *, len(list_filter(ws, lambda x: upper(x[1]) = x[1] AND lower(x[1]) <> x[1])) AS caps, upper(ws[1][1]) = ws[1][1] AND lower(ws[1][1]) <> ws[1][1] AS first, upper(line) = line AND lower(line) <> line AS up, NOT regexp_matches(line, '[.,;:!?]$') AS open FROM w),
h AS (SELECT *, length(line) <= 100 AND (regexp_matches(line, '^([0-9]+(\.[0-9]+)*[.)]?\s+\w|[IVX]+[.)]\s+\w)') OR (up AND len(ws) >= 2) OR (len(ws) >= 2 AND first AND caps >= greatest(len(ws) * 0.5, 1) AND open) OR (len(ws) <= 3 AND length(line) > 3 AND open AND (up OR first))) AS head FROM k),
p AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM h)"""


def headed(spark, sf_dir) -> DataFrame:
    """The documents' lines, every fourth one a numbered heading."""
    line = F.transform(F.split("text", "\n", -1), lambda x, i: F.when((i + 1) % 4 == 0, F.concat(F.floor((i + 1) / 4).cast("string"), F.lit(". Section Heading"))).otherwise(x))
    return symbolic.lines(table(spark, sf_dir, "documents").withColumn("text", F.array_join(line, "\n")))


@query("heading_paragraphs", f"WITH {HEADED} SELECT doc_id, part::BIGINT AS part, coalesce(max(line) FILTER (head), '') AS heading, count(*) FILTER (NOT head) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT head)) AS body_md5 FROM p GROUP BY doc_id, part HAVING count(*) FILTER (NOT head) > 0")
def heading_paragraphs(spark, sf_dir):
    return symbolic.paragraphs(headed(spark, sf_dir)).select("doc_id", "part", "heading", "n_lines", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def vectors_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every row whose id is divisible by 50 as a query, against all rows but its own."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec")), rows


SCORED = "s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)"


@query("dense_topk", f"WITH {SCORED} SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    q, rows = vectors_of(spark, sf_dir)
    return retrieval.nearest(q, rows, 10, "vec_id", itself=False)


@query("topk_section_filter", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM r WHERE r <= 20 AND label < 3) SELECT query_id, vec_id, score, rank::INT AS rank FROM f WHERE rank <= 10")
def topk_section_filter(spark, sf_dir):
    q, rows = vectors_of(spark, sf_dir)
    kept = retrieval.nearest(q, rows, 20, "vec_id", ["label"], itself=False).where("label < 3")
    return retrieval.ranked_again(kept, 10).select("query_id", "vec_id", "score", "rank")


HASHED = r"""
tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\t\n\x0B\f\r ]+'), lambda x: x <> '')) AS t FROM documents),
qt AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\t\n\x0B\f\r ]+'), lambda x: x <> '')) AS t FROM benchmark),
dv AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS c FROM tok GROUP BY ALL), dn AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM dv GROUP BY 1),
qv AS (SELECT item_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS c FROM qt GROUP BY ALL), qn AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM qv GROUP BY 1),
s AS (SELECT item_id AS query_id, doc_id, round(sum(dv.c * qv.c) / any_value(dn.n) / any_value(qn.n), 6) AS score FROM dv JOIN qv USING (b) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY ALL)"""


@query("hash_embed_search", f"WITH {HASHED} SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 5")
def hash_embed_search(spark, sf_dir):
    embed = models.HashEmbedder().embed
    docs = table(spark, sf_dir, "documents").select("doc_id", embed(F.col("text")).alias("embedding"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), embed(F.col("text")).alias("q_vec"))
    scored = retrieval.score_all(q, docs, measure=lambda a, b: F.round(vectors.dot(a, b), 6))
    return retrieval.top_k(scored, 5, tie="doc_id").select("query_id", "doc_id", "score")


TAGGED = "g AS (SELECT doc_id, source, " + ", ".join("0.5 * (" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in ws) + f") AS {t}" for t, ws in KEYWORDS.items()) + " FROM documents), "
TAGGED += 'mx AS (SELECT *, CASE WHEN greatest(T, E, M, A) = 0 THEN 1 ELSE greatest(T, E, M, A) END AS top FROM g), tg AS (SELECT *, CASE WHEN T >= greatest(E, M, A) THEN \'T\' WHEN E >= greatest(M, A) THEN \'E\' WHEN M >= A THEN \'M\' ELSE \'A\' END AS tag FROM mx)'


@query("classify_tags", f"WITH {TAGGED} SELECT doc_id, round((T / top)::DOUBLE, 3) AS t, round((E / top)::DOUBLE, 3) AS e, round((M / top)::DOUBLE, 3) AS m, round((A / top)::DOUBLE, 3) AS a, tag FROM tg")
def classify_tags(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", scores.tag_scores("text", KEYWORDS).alias("s"))
    each = [F.get("s", F.lit(i))["score"].cast("double").alias(t.lower()) for i, t in enumerate(scores.TAGS)]
    return s.select("doc_id", *each, F.get(scores.top_tags("s", 1), F.lit(0))["tag"].alias("tag"))


@query("tag_pivot", f"WITH {TAGGED} SELECT source, " + ", ".join(f"count(*) FILTER (tag = '{t}') AS {t.lower()}" for t in "TEMA") + " FROM tg GROUP BY 1")
def tag_pivot(spark, sf_dir):
    tagged = table(spark, sf_dir, "documents").select("source", scores.primary_tag("text", KEYWORDS).alias("tag"))
    return selection.tag_counts(tagged, ["source"]).select("source", *[F.col(t).alias(t.lower()) for t in scores.TAGS])


RERANK = r"q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2)) AS w FROM benchmark)"


@query("rerank_topn", f"WITH {RERANK}, s AS (SELECT item_id AS query_id, doc_id, len(list_filter(w, lambda x: contains(lower(text), x)))::DOUBLE / len(w) AS score FROM q, documents WHERE len(w) > 0) SELECT query_id, doc_id, round(1 / (1 + exp(-score)), 6) AS score, n::INT AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM s) WHERE n <= 5")
def rerank_topn(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.query_terms("text").alias("terms"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text")
    found = postings.holding(q.select(F.col("query_id").alias("item"), "terms").where(F.size("terms") > 0), docs, 5)
    found = found.select(F.col("item").alias("query_id"), F.col("source").alias("doc_id"), "score")
    best = retrieval.rerank(found, F.col("score"), 5, tie="doc_id")
    return best.select("query_id", "doc_id", F.round(scores.sigmoid("rerank_score"), 6).alias("score"), "new_rank")


SUPPORT = rf"""
f AS (SELECT item_id, text AS ft, {STRIP('lower(text)')} AS fl, list_distinct(regexp_extract_all(text, '[0-9]+\.?[0-9]*')) AS fn, list_filter(list_distinct(list_filter(regexp_split_to_array({STRIP('lower(text)')}, '[\t\n\x0B\f\r ]+'), lambda x: x <> '')), lambda x: x NOT IN ({STOP})) AS fw FROM benchmark),
d AS (SELECT doc_id, text AS dt, lower(text) AS dl, list_distinct(regexp_extract_all(text, '[0-9]+\.?[0-9]*')) AS dn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\t\n\x0B\f\r ]+'), lambda x: x <> '')) AS dw FROM documents WHERE doc_id % 10 = 0 OR doc_id % 10 > 0),
v AS (SELECT item_id, doc_id, CASE WHEN contains(dl, fl) THEN 1.0 WHEN len(fw) = 0 THEN 0.0 WHEN len(fn) > 0 THEN least(1.0, len(list_intersect(fw, dw))::DOUBLE / len(fw) * 0.5 + len(list_intersect(fn, dn))::DOUBLE / len(fn) * 0.5) ELSE least(1.0, len(list_intersect(fw, dw))::DOUBLE / len(fw)) END AS c FROM f, d)"""
SUPPORT = SUPPORT.replace(" WHERE doc_id % 10 = 0 OR doc_id % 10 > 0", "")


@query("verify_local", f"WITH {SUPPORT}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(c, 6) DESC, doc_id) AS n FROM v) SELECT item_id, doc_id, round(c, 6)::DOUBLE AS confidence, c >= 0.7 AS verified, CASE WHEN c >= 0.9 THEN 'local_exact' ELSE 'local_partial' END AS method FROM r WHERE n <= 3")
def verify_local(spark, sf_dir):
    facts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text")
    best = postings.supporting(facts, docs, 3).select(F.col("item").alias("item_id"), F.col("source").alias("doc_id"), F.col("score").alias("confidence"))
    return best.select("item_id", "doc_id", "confidence", (F.col("confidence") >= 0.7).alias("verified"), F.when(F.col("confidence") >= 0.9, "local_exact").otherwise("local_partial").alias("method"))


FACTS = f"{MARKED}, {SENTENCES}, fa AS (SELECT doc_id || ':' || n AS fact_id, CASE WHEN doc_id % 4 = 0 THEN doc_id + 1 ELSE doc_id END AS source_doc, x AS ft FROM s)"


DECIDED = rf"WITH {FACTS}, x AS (SELECT fact_id, ft, text AS dt, {STRIP('lower(ft)')} AS fl, lower(text) AS dl FROM fa LEFT JOIN documents ON doc_id = source_doc), y AS (SELECT *, list_distinct(regexp_extract_all(ft, '[0-9]+\.?[0-9]*')) AS fn, list_distinct(regexp_extract_all(dt, '[0-9]+\.?[0-9]*')) AS dn, list_filter(list_distinct(list_filter(regexp_split_to_array(fl, '[\t\n\x0B\f\r ]+'), lambda x: x <> '')), lambda x: x NOT IN ({STOP})) AS fw, list_filter(regexp_split_to_array(dl, '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS dw FROM x), z AS (SELECT fact_id, dt, ft, CASE WHEN contains(dl, fl) THEN 1.0 WHEN len(fw) = 0 THEN 0.0 WHEN len(fn) > 0 THEN len(list_intersect(fw, dw))::DOUBLE / len(fw) * 0.5 + len(list_intersect(fn, dn))::DOUBLE / len(fn) * 0.5 ELSE len(list_intersect(fw, dw))::DOUBLE / len(fw) END AS c FROM y) SELECT fact_id, CASE WHEN coalesce(dt, '') = '' OR ft = '' THEN false ELSE c >= 0.7 END AS verified, CASE WHEN coalesce(dt, '') = '' OR ft = '' THEN 0.0 WHEN c >= 0.9 THEN round(c, 3) ELSE round(c, 3) END::DOUBLE AS confidence, CASE WHEN coalesce(dt, '') = '' OR ft = '' THEN 'none' WHEN c >= 0.9 THEN 'local_exact' ELSE 'local_partial' END AS method FROM z"


@query("verify_decision", DECIDED)
def verify_decision(spark, sf_dir):
    return decided(spark, sf_dir).select("fact_id", "verified", F.round("confidence", 3).alias("confidence"), "method")


def decided(spark, sf_dir) -> DataFrame:
    """Every sentence of every text as a fact, of every fourth text against the next one."""
    docs = table(spark, sf_dir, "documents")
    cut = marked(spark, sf_dir).select("doc_id", F.posexplode(text.sentences("text")).alias("n", "text"))
    source = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("source_doc")
    facts = cut.select(F.concat_ws(":", "doc_id", "n").alias("fact_id"), source, "text")
    return attribution.verify_facts(facts, docs.select(F.col("doc_id").alias("document_id"), F.col("text").alias("source_text")))


@query("report_stats", f"SELECT split_part(fact_id, ':', 1)::BIGINT AS doc_id, count(*) AS total_facts, count(*) FILTER (verified) AS verified_facts, count(*) FILTER (verified) || '/' || count(*) || ' = ' || round(count(*) FILTER (verified) / count(*)::DOUBLE * 100)::BIGINT || '%' AS verification_rate FROM ({DECIDED}) GROUP BY 1")
def report_stats(spark, sf_dir):
    """What a report says of its facts, for the facts of every document."""
    facts = decided(spark, sf_dir).withColumn("doc_id", F.split("fact_id", ":")[0].cast("long"))
    return synthesis.report_statistics(facts, ["doc_id"]).drop("mean_confidence")


TITLES = rf"""
p AS (SELECT doc_id AS ord, substr(text, 1, 80) AS title, CASE WHEN doc_id % 5 = 0 THEN '10.1/' || (doc_id % 50) END AS doi FROM documents),
k AS (SELECT ord, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({TITLE_STOP}))) AS w FROM p),
pairs AS MATERIALIZED (SELECT a, b, similarity FROM (SELECT x.ord AS a, y.ord AS b, len(list_intersect(x.w, y.w))::DOUBLE / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) AS similarity FROM k x JOIN k y ON x.ord < y.ord AND len(x.w) > 0 AND len(y.w) > 0) WHERE similarity >= 0.82)"""


def papers(spark, sf_dir) -> DataFrame:
    """documents as found papers: a title, a DOI for every fifth."""
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.substring("text", 1, 80).alias("title"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("10.1/"), (F.col("doc_id") % 50).cast("string"))).alias("doi"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))).alias("pdf_url"), none.alias("pdf_alternatives"),
        F.col("n_chars").cast("int").alias("citation_count"), F.lit(0.0).alias("relevance_score"),
    )


@query("title_jaccard_pairs", f"WITH {TITLES} SELECT a, b, round(similarity, 9) AS similarity FROM pairs")
def title_jaccard_pairs(spark, sf_dir):
    tokens = papers(spark, sf_dir).select(F.col("ord").alias("id"), text.title_tokens("title").alias("tokens"))
    return dedup.similar_pairs(tokens, 0.82).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("fuzzy_dedup_exact", f"WITH {TITLES}, e AS (SELECT CASE WHEN doi IS NOT NULL THEN 'd' || doi ELSE 't' || {STRIP('lower(title)')} END AS key, ord FROM p) SELECT min(ord) AS ord, count(*) AS n FROM e GROUP BY key")
def fuzzy_dedup_exact(spark, sf_dir):
    key = F.when(F.col("doi").isNotNull(), F.concat(F.lit("d"), "doi")).otherwise(F.concat(F.lit("t"), dedup.title_key("title")))
    return papers(spark, sf_dir).groupBy(key.alias("key")).agg(F.min("ord").alias("ord"), F.count("*").alias("n")).drop("key")


@query("fuzzy_dedup")
def fuzzy_dedup(spark, sf_dir):
    return dedup.deduplicate(papers(spark, sf_dir)).select("ord", "title", "doi", "pdf_url", "citation_count")


@query("fingerprints", f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'doi:10.1/' || (doc_id % 50) ELSE substr({STRIP('lower(substr(text, 1, 80))')}, 1, 80) END AS fingerprint FROM documents")
def fingerprints(spark, sf_dir):
    return papers(spark, sf_dir).select(F.col("ord").alias("doc_id"), text.fingerprint("doi", "title").alias("fingerprint"))


@query("rank_papers", "WITH s AS (SELECT d.doc_id, " + " + ".join(f"(CASE WHEN contains(lower(substr(text, 1, 80)), '{w}') THEN 5.0 ELSE 0 END) + (CASE WHEN contains(lower(text), '{w}') THEN 1.0 ELSE 0 END)" for w in ("thing", "erble")) + " + least(n_chars / 50.0, 15.0) + (CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) + (CASE WHEN d.doc_id % 2 = 0 THEN 0.5 ELSE 0 END) + (CASE WHEN source = 'src1' THEN 0.3 ELSE 0 END) AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) SELECT doc_id, round(score::DOUBLE, 6) AS score, n::INT AS position FROM (SELECT *, row_number() OVER (ORDER BY round(score::DOUBLE, 6) DESC, doc_id) AS n FROM s) WHERE n <= 50")
def rank_papers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    api = F.when(F.col("source") == "src1", "arxiv").otherwise(F.col("source"))
    score = scores.paper_relevance(F.substring("text", 1, 80), "text", ["thing", "erble"], "n_chars", F.col("quality") == 1, F.col("doc_id") % 2 == 0, api)
    top = docs.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)  # a top-50 report
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


@query("query_terms", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda x: length(x) > 2))), ' ') AS terms, CASE WHEN len(list_filter(regexp_split_to_array(p_name, '\\s+'), lambda x: x <> '')) < 4 AND contains(lower(p_name), 'machine learning') THEN 'machine learning artificial intelligence' ELSE p_name END AS expanded FROM part")
def query_terms(spark, sf_dir):
    terms = F.array_join(F.array_sort(text.query_terms(F.concat_ws(" ", "p_name", "p_type"))), " ")
    return table(spark, sf_dir, "part").select("p_partkey", terms.alias("terms"), text.expand_query("p_name").alias("expanded"))


CAND = f"WITH {TAGGED}, ca AS (SELECT doc_id, tag, row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) AS rank FROM tg)"


def ranked_candidates(spark, sf_dir) -> DataFrame:
    """Documents with tags, in the order of a hash: a ranking that has nothing to do with their tags."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), scores.primary_tag("text", KEYWORDS).alias("tag"))
    return docs.withColumn("rank", F.md5(F.col("paper_id").cast("string").cast("binary")))


CHOSEN = CAND + ", b(tag, budget, o) AS (VALUES ('T', 8, 0), ('E', 8, 1), ('M', 7, 2), ('A', 7, 3)), n AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY rank) AS n FROM ca JOIN b USING (tag)), x AS (SELECT *, CASE WHEN n <= budget THEN 1 ELSE 2 END AS pass FROM n), q AS (SELECT *, row_number() OVER (ORDER BY pass, CASE WHEN pass = 1 THEN o ELSE n - budget END, CASE WHEN pass = 1 THEN n ELSE o END) AS position FROM x)"


@query("coverage_select", CHOSEN + " SELECT doc_id AS paper_id, tag, pass::INT AS pass, position::INT AS position FROM q WHERE pass = 1 OR position <= 30")
def coverage_select(spark, sf_dir):
    return selection.select_evidence(ranked_candidates(spark, sf_dir), 30).drop("rank")


@query("coverage_notes", CHOSEN + ", k AS (SELECT tag, count(*) AS selected FROM q WHERE pass = 1 OR position <= 30 GROUP BY 1) SELECT tag, coalesce(selected, 0)::BIGINT AS selected, budget, CASE WHEN coalesce(selected, 0) < budget THEN 'Under-covered tag ' || tag || ': selected ' || coalesce(selected, 0) || ' vs budget ' || budget END AS note FROM b LEFT JOIN k USING (tag)")
def coverage_notes(spark, sf_dir):
    return selection.coverage_report(selection.select_evidence(ranked_candidates(spark, sf_dir), 30), 30)


@query("coverage_clusters", CHOSEN + " SELECT 'cluster_' || tag AS cluster_id, doc_id AS paper_id, (row_number() OVER (PARTITION BY tag ORDER BY position))::INT AS nth, count(*) OVER (PARTITION BY tag) AS n FROM q WHERE pass = 1 OR position <= 30")
def coverage_clusters(spark, sf_dir):
    """The papers that coverage selection takes from all documents, by cluster."""
    return selection.clusters(selection.select_evidence(ranked_candidates(spark, sf_dir), 30), 30).select("cluster_id", "paper_id", "nth", "n")


@query("candidate_docs", f"WITH {SCORED}, r AS (SELECT query_id, label, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, label, arg_min(vec_id, rank) AS vec_id, min(rank)::INT AS rank FROM r WHERE rank <= 50 GROUP BY ALL")
def candidate_docs(spark, sf_dir):
    q, rows = vectors_of(spark, sf_dir)
    top = retrieval.nearest(q, rows, 50, "vec_id", ["label"], itself=False)
    return top.groupBy("query_id", "label").agg(F.min_by("vec_id", "rank").alias("vec_id"), F.min("rank").alias("rank"))


@query("evidence_semi", "SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def evidence_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("theme_status", "WITH u AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), o AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT d.doc_id, CASE WHEN u.doc_id IS NOT NULL OR o.doc_id IS NOT NULL THEN 'used' ELSE 'remaining' END AS status, u.doc_id IS NOT NULL AND o.doc_id IS NULL AS newly_used FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN u USING (doc_id) LEFT JOIN o USING (doc_id)")
def theme_status(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return sinks.theme_status(table(spark, sf_dir, "documents"), labels.where("quality = 1"), labels.where("toxic = 1"))


@query("remaining_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def remaining_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


EV = "e AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS v, count(*) AS t, count(*) FILTER (event_type = 'error') AS g FROM events GROUP BY 1), r AS (SELECT *, CASE WHEN t <= 0 THEN 0 ELSE v::DOUBLE / t END AS ratio, 1.0::DOUBLE / (1 + g) AS proxy FROM e)"
GATE = "v >= 2 AND ratio >= 0.2 AND g <= 2"


@query("sufficiency_modes", f"WITH {EV} SELECT user_id, {GATE} AS verified_facts, proxy >= 0.3 AND g <= 2 AS gap_coverage, v >= 2 AND proxy >= 0.3 AND g <= 2 AS hybrid, {GATE} AND t >= 6 AND proxy >= 0.3 AS hybrid_v2, 'hybrid_v2_gate:' || CASE WHEN t < 6 THEN 'pool_too_small' WHEN {GATE} AND proxy >= 0.3 THEN 'all_gates_passed' ELSE concat_ws('_', CASE WHEN v < 2 THEN 'verified_facts_below_min' END, CASE WHEN ratio < 0.2 THEN 'verified_ratio_below_min' END, CASE WHEN g > 2 THEN 'with_gaps_exceeds_max' END, CASE WHEN proxy < 0.3 THEN 'coverage_proxy_below_min' END) END AS reason, round(0.45 * least(ratio, 1) + 0.35 / (1 + g) + 0.2 * proxy, 6)::DOUBLE AS score FROM r")
def sufficiency_modes(spark, sf_dir):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(kind("purchase").alias("v"), F.count("*").alias("t"), kind("error").alias("g"))
    limits = {"min_verified_facts": 2, "min_coverage_sentences": 0.2, "max_gaps": 2, "min_sentence_pool": 6, "min_coverage_proxy": 0.3}
    s = {m: scores.sufficiency("v", "t", "g", m, limits) for m in ("verified_facts", "gap_coverage", "hybrid", "hybrid_v2")}
    return users.select("user_id", *[x["passed"].alias(m) for m, x in s.items()], s["hybrid_v2"]["reason"].alias("reason"), F.round(s["hybrid_v2"]["score"], 6).alias("score"))


@query("node_quality", "SELECT source, round(CASE WHEN count(*) = 0 THEN 0.2 ELSE least(count(*) / 60.0::DOUBLE / 5 * 5, 1) END, 6) AS x, round(CASE WHEN count(DISTINCT lang) = 0 THEN 0.2 ELSE least(count(DISTINCT lang) / 5.0::DOUBLE, 1) * 0.4 + least(min(n_chars) / 500.0::DOUBLE, 1) * 0.3 + least((count(*) % 4) / 3.0::DOUBLE, 1) * 0.3 END, 6) AS quality FROM documents GROUP BY 1".replace("round(CASE WHEN count(*) = 0 THEN 0.2 ELSE least(count(*) / 60.0::DOUBLE / 5 * 5, 1) END, 6) AS x, ", ""))
def node_quality(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.countDistinct("lang").alias("f"), F.min("n_chars").alias("d"), (F.count("*") % 4).alias("c"))
    return by.select("source", F.round(scores.node_quality("f", "d", "c"), 6).alias("quality"))


@query("dup_penalty", "SELECT conv_id, turn, round(CASE WHEN row_number() OVER (PARTITION BY substr(text, 1, 100) ORDER BY conv_id, turn) > 1 THEN 0.9 * 0.8 ELSE 0.9 END::DOUBLE, 6) AS confidence FROM conversations")
def dup_penalty(spark, sf_dir):
    facts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("bfs"), F.col("turn").alias("fact_ord"), "text", F.lit(0.9).alias("confidence"))
    return tree.duplicate_penalty(facts).select(F.col("bfs").alias("conv_id"), F.col("fact_ord").alias("turn"), F.round("confidence", 6).alias("confidence"))


EDGES = """edge AS MATERIALIZED (
  SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst)"""


def edges_of(spark, sf_dir) -> DataFrame:
    """A citation graph from orders: from the part of every line to that of the next. Lines that the order leaves tied have one part,
    so however they fall the pairs are the same."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return li.where("dst IS NOT NULL AND src <> dst").distinct()


def parts_1(spark) -> DataFrame:
    return spark.range(1, 2).withColumnRenamed("id", "node")


HOPS = "h1 AS (SELECT DISTINCT {b} AS node FROM edge WHERE {a} = 1), h2 AS (SELECT DISTINCT {b} AS node FROM h1 JOIN edge ON {a} = node)"


@query("graph_backward", f"WITH {EDGES}, {HOPS.format(a='src', b='dst')} SELECT node, min(hop)::INT AS hop FROM (SELECT node, 1 AS hop FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY 1")
def graph_backward(spark, sf_dir):
    return graph.k_hop(edges_of(spark, sf_dir), parts_1(spark), 2)


@query("graph_forward", f"WITH {EDGES}, {HOPS.format(a='dst', b='src')} SELECT node, min(hop)::INT AS hop FROM (SELECT node, 1 AS hop FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY 1")
def graph_forward(spark, sf_dir):
    return graph.k_hop(edges_of(spark, sf_dir), parts_1(spark), 2, forward=True)


@query("explore_first", f"WITH {EDGES}, {HOPS.format(a='src', b='dst')}, h3 AS (SELECT DISTINCT dst AS node FROM h2 JOIN edge ON src = node) SELECT node, min(hop)::INT AS hop FROM (SELECT node, 1 AS hop FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3) GROUP BY 1 ORDER BY 2, 1 LIMIT 25")
def explore_first(spark, sf_dir):
    return graph.explore_first(edges_of(spark, sf_dir), parts_1(spark), 25)


@query("parallel_explore", f"WITH {EDGES}, n AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM edge WHERE src BETWEEN 1 AND 20) SELECT DISTINCT dst AS node FROM n WHERE n <= 3")
def parallel_explore(spark, sf_dir):
    return graph.explore_parallel(edges_of(spark, sf_dir), spark.range(1, 21).withColumnRenamed("id", "node"), 3)


@query("neighbour_jaccard", f"WITH {EDGES}, b AS (SELECT src AS node, dst AS near FROM edge UNION SELECT dst, src FROM edge), o AS (SELECT near FROM b WHERE node = 1), s AS (SELECT node, count(*) AS d, count(*) FILTER (near IN (SELECT near FROM o)) AS c FROM b WHERE node <> 1 GROUP BY 1) SELECT node, round(c::DOUBLE / (d + (SELECT count(*) FROM o) - c), 9) AS score FROM s ORDER BY score DESC, node LIMIT 10")
def neighbour_jaccard(spark, sf_dir):
    return graph.related(edges_of(spark, sf_dir), 1, 10).select("node", F.round("score", 9).alias("score"))


@query("graph_stats", f"WITH {EDGES}, n AS (SELECT src AS x FROM edge UNION SELECT dst FROM edge) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM edge) AS edges, round((SELECT count(*) FROM edge)::DOUBLE / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)), 4) AS density")
def graph_stats(spark, sf_dir):
    return graph.graph_stats(edges_of(spark, sf_dir))


@query("shortest_path", f"WITH RECURSIVE {EDGES}, lv AS (SELECT 1::BIGINT AS node, 0 AS hop UNION SELECT DISTINCT dst, hop + 1 FROM lv JOIN edge ON src = node WHERE hop < 8), d AS MATERIALIZED (SELECT node, min(hop) AS hop FROM lv GROUP BY 1), k AS (SELECT node, hop FROM d WHERE node = 77 UNION ALL SELECT * FROM (SELECT e.src, k.hop - 1 FROM k JOIN edge e ON e.dst = k.node JOIN d ON d.node = e.src AND d.hop = k.hop - 1 ORDER BY e.src LIMIT 1)) SELECT hop::INT AS hop, node FROM k")
def shortest_path(spark, sf_dir):
    return graph.shortest_path(edges_of(spark, sf_dir), 1, 77)


@query("expand_levels", f"WITH {EDGES}, a AS (SELECT DISTINCT dst AS node FROM edge WHERE src = 1 AND dst <> 1 ORDER BY 1 LIMIT 10), b AS (SELECT DISTINCT dst AS node FROM edge JOIN a ON src = node WHERE dst <> 1 AND dst NOT IN (SELECT node FROM a) ORDER BY 1 LIMIT 10) SELECT node, 1 AS level FROM a UNION ALL SELECT node, 2 FROM b")
def expand_levels(spark, sf_dir):
    return graph.expand(edges_of(spark, sf_dir), parts_1(spark), 2)


def outline(spark, sf_dir) -> DataFrame:
    """regions, nations and suppliers as an outline of three levels."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit("root").alias("parent_id"), F.col("r_regionkey").cast("int").alias("ord"), F.col("r_name").alias("title"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey").cast("int"), F.col("n_name"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.col("s_suppkey").cast("int"), F.col("s_name"))
    root = spark.range(1).select(F.lit("root"), F.lit(None).cast("string"), F.lit(0), F.lit("World"))
    whole = root.union(r).union(n).union(s).toDF("node_id", "parent_id", "ord", "title")
    whole = whole.withColumn("description", F.concat(F.lit("About "), "title")).withColumn("draft", F.concat(F.lit("Text of "), "title"))
    return whole.withColumn("confidence", (F.col("ord") % 10) / 10.0).withColumn("is_complete", F.col("ord") % 2 == 0).withColumn("gaps", F.when(F.col("ord") % 5 == 0, F.array(F.lit("gap"))).otherwise(F.array().cast("array<string>")))


TREE = "tr AS (SELECT 'root' AS node_id, NULL AS parent_id, 0 AS ord, 'World' AS title, 0 AS depth, 'root' AS path UNION ALL SELECT 'r' || r_regionkey, 'root', r_regionkey::INT, r_name, 1, 'root/r' || r_regionkey FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey::INT, n_name, 2, 'root/r' || n_regionkey || '/n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey::INT, s_name, 3, 'root/r' || n_regionkey || '/n' || s_nationkey || '/s' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey), lf AS (SELECT *, node_id NOT IN (SELECT parent_id FROM tr WHERE parent_id IS NOT NULL) AS leaf FROM tr)"


@query("tree_paths", f"WITH {TREE} SELECT node_id, depth, path, leaf AS is_leaf FROM lf")
def tree_paths(spark, sf_dir):
    return tree.add_depth(outline(spark, sf_dir)).select("node_id", "depth", F.array_join("path", "/").alias("path"), "is_leaf")


@query("tree_stats", f"WITH {TREE} SELECT count(*) AS total_nodes, max(depth)::INT AS max_depth, count(*) FILTER (leaf) AS leaves, count(*) FILTER (ord % 2 = 0) AS complete, count(*) FILTER (ord % 5 = 0) AS with_gaps, round(avg(ord % 10 / 10.0::DOUBLE) FILTER (leaf), 2) AS avg_confidence FROM lf")
def tree_stats(spark, sf_dir):
    return tree.tree_stats(tree.add_depth(outline(spark, sf_dir)))


@query("siblings", f"WITH {TREE} SELECT a.node_id, count(*) AS n, min(b.node_id) AS first FROM tr a JOIN tr b ON a.parent_id = b.parent_id AND a.node_id <> b.node_id GROUP BY 1")
def siblings(spark, sf_dir):
    return tree.sibling_counts(outline(spark, sf_dir))


@query("leaf_descendants", f"WITH {TREE} SELECT a.node_id AS ancestor, count(*) AS leaves FROM lf a JOIN lf b ON b.leaf AND starts_with(b.path, a.path || '/') GROUP BY 1")
def leaf_descendants(spark, sf_dir):
    return tree.leaf_descendants(outline(spark, sf_dir)).groupBy("ancestor").agg(F.count("*").alias("leaves"))


PREORDER = "po AS (SELECT t.node_id, t.depth, t.path, row_number() OVER (ORDER BY CASE t.depth WHEN 0 THEN [0] WHEN 1 THEN [0, t.ord] WHEN 2 THEN [0, u.ord, t.ord] ELSE [0, v.ord, u.ord, t.ord] END) - 1 AS pre FROM tr t LEFT JOIN tr u ON u.node_id = t.parent_id LEFT JOIN tr v ON v.node_id = u.parent_id), sz AS (SELECT a.node_id, count(*) AS n FROM tr a JOIN tr b ON b.path = a.path OR starts_with(b.path, a.path || '/') GROUP BY 1)"


@query("tree_intervals", f"WITH {TREE}, {PREORDER} SELECT node_id, depth, 2 * pre - depth AS enter, 2 * pre - depth + 2 * n - 1 AS leave FROM po JOIN sz USING (node_id)")
def tree_intervals(spark, sf_dir):
    return tree.intervals(outline(spark, sf_dir))


@query("bfs_order", f"WITH {TREE}, p AS (SELECT t.node_id, t.depth, CASE t.depth WHEN 0 THEN [0] WHEN 1 THEN [0, t.ord] WHEN 2 THEN [0, u.ord, t.ord] ELSE [0, v.ord, u.ord, t.ord] END AS po FROM tr t LEFT JOIN tr u ON u.node_id = t.parent_id LEFT JOIN tr v ON v.node_id = u.parent_id) SELECT node_id, row_number() OVER (ORDER BY depth, po) AS bfs FROM p")
def bfs_order(spark, sf_dir):
    return tree.bfs_order(tree.add_depth(outline(spark, sf_dir))).select("node_id", F.col("bfs").cast("long").alias("bfs"))


ROLL = TREE + ", l3 AS (SELECT node_id, parent_id, ord, title, 'Text of ' || title AS d FROM lf WHERE leaf), m2 AS (SELECT n.node_id, n.parent_id, n.ord, n.title, '## ' || n.title || chr(10) || chr(10) || 'About ' || n.title || chr(10) || chr(10) || string_agg('### ' || l.title || chr(10) || chr(10) || l.d, chr(10) || chr(10) ORDER BY l.ord) AS d FROM lf n JOIN l3 l ON l.parent_id = n.node_id WHERE n.depth = 2 GROUP BY n.node_id, n.parent_id, n.ord, n.title), a2 AS (SELECT * FROM m2 UNION ALL SELECT l3.* FROM l3 JOIN lf USING (node_id) WHERE lf.depth = 2), m1 AS (SELECT n.node_id, n.parent_id, n.ord, n.title, '## ' || n.title || chr(10) || chr(10) || 'About ' || n.title || chr(10) || chr(10) || string_agg('### ' || l.title || chr(10) || chr(10) || l.d, chr(10) || chr(10) ORDER BY l.ord) AS d FROM lf n JOIN a2 l ON l.parent_id = n.node_id WHERE n.depth = 1 GROUP BY n.node_id, n.parent_id, n.ord, n.title), m0 AS (SELECT 'root' AS node_id, '## World' || chr(10) || chr(10) || 'About World' || chr(10) || chr(10) || string_agg('### ' || title || chr(10) || chr(10) || d, chr(10) || chr(10) ORDER BY ord) AS d FROM m1)"


@query("tree_rollup", f"WITH {ROLL} SELECT node_id, length(d)::BIGINT AS chars, md5(d) AS md5 FROM (SELECT node_id, d FROM l3 UNION ALL SELECT node_id, d FROM m2 UNION ALL SELECT node_id, d FROM m1 UNION ALL SELECT node_id, d FROM m0)")
def tree_rollup(spark, sf_dir):
    drafts = tree.roll_up(tree.add_depth(outline(spark, sf_dir)))
    return drafts.select("node_id", F.char_length("draft").cast("long").alias("chars"), F.md5(F.col("draft").cast("binary")).alias("md5"))


BIO = "t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE role WHEN 'user' THEN 'B' WHEN 'assistant' THEN 'I' ELSE 'O' END AS tag FROM conversations), g AS (SELECT *, sum((tag <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS run FROM t)"


@query("bio_spans", f"WITH {BIO} SELECT conv_id, min(i)::INT AS st, (max(i) + 1)::INT AS ed FROM g GROUP BY conv_id, run HAVING arg_min(tag, i) = 'B'")
def bio_spans(spark, sf_dir):
    tag = F.when(F.col("role") == "user", "B").when(F.col("role") == "assistant", "I").otherwise("O")
    return symbolic.bio_spans(table(spark, sf_dir, "conversations").select("conv_id", "turn", tag.alias("tag")), "conv_id", "turn")


@query("info_unit_rollup", "SELECT event_type AS unit_type, user_id AS paper_id, count(*) AS n, 0 AS level FROM events GROUP BY 1, 2 UNION ALL SELECT event_type, NULL, count(*), 1 FROM events GROUP BY 1")
def info_unit_rollup(spark, sf_dir):
    units = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("unit_type"))
    return symbolic.unit_roll_up(units).select("unit_type", "paper_id", "n", F.col("level").cast("int").alias("level"))


WORDS = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS w FROM documents), tp AS (SELECT doc_id, w[1] AS s, w[2] AS p, w[3] AS o, (doc_id % 4)::INT AS c, w FROM w WHERE len(w) >= 3)"


def triples_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Triples from the first three words of a document; terms: all its words in sentences of ten."""
    w = table(spark, sf_dir, "documents").select("doc_id", text.words(F.lower("text")).alias("w")).where(F.size("w") >= 3)
    part = lambda i: F.get("w", F.lit(i))
    triples = w.select(F.col("doc_id").alias("paper_id"), F.col("doc_id").alias("triple_id"), part(0).alias("subject"), part(1).alias("predicate"), part(2).alias("object"), (F.col("doc_id") % 4).cast("int").alias("completeness"), (F.col("doc_id") % 7).alias("sentence_idx"))
    terms = w.select(F.col("doc_id").alias("paper_id"), F.posexplode("w").alias("i", "term")).select("paper_id", F.floor(F.col("i") / 10).alias("sentence_idx"), "term")
    return triples, terms


@query("triple_resolution", f"WITH {WORDS}, e AS (SELECT doc_id, (i - 1) // 10 AS s, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM tp)), n AS (SELECT tp.doc_id, count(DISTINCT e.s) AS n FROM tp JOIN e ON e.doc_id = tp.doc_id AND e.t IN (tp.s, tp.p, tp.o) GROUP BY 1) SELECT tp.doc_id AS paper_id, CASE WHEN c >= 3 THEN c ELSE least(coalesce(n, 0), 2) END::INT AS completeness FROM tp LEFT JOIN n USING (doc_id)")
def triple_resolution(spark, sf_dir):
    triples, terms = triples_of(spark, sf_dir)
    return symbolic.resolve_triples(symbolic.valid_triples(triples), terms).select("paper_id", "completeness")


@query("completeness_histogram", f"WITH {WORDS} SELECT c AS completeness, count(*) AS n, c >= 2 AS fully_resolved FROM tp GROUP BY 1")
def completeness_histogram(spark, sf_dir):
    return symbolic.completeness_histogram(triples_of(spark, sf_dir)[0])


@query("evidence_lookup", f"WITH {WORDS}, k AS (SELECT s || '||' || p || '||' || o AS k, arg_max(doc_id % 7, doc_id) AS x FROM tp GROUP BY 1) SELECT doc_id AS paper_id, x AS sentence_idx FROM tp JOIN k ON k = s || '||' || p || '||' || o")
def evidence_lookup(spark, sf_dir):
    triples, _ = triples_of(spark, sf_dir)
    wanted = triples.select("paper_id", "subject", "predicate", "object")
    return symbolic.evidence_lookup(wanted, triples).select("paper_id", "sentence_idx")


@query("theme_ids", "SELECT p_partkey, substr(lower(regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 48) || '_' || substr(sha256(p_name), 1, 16) AS theme_id, md5('paper:' || p_name) AS cache_key, 'firecrawl://' || substr(sha256(p_name), 1, 16) AS report_id FROM part")
def theme_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.theme_id("p_name").alias("theme_id"), text.cache_key(F.lit("paper"), "p_name").alias("cache_key"), text.report_id("p_name").alias("report_id"))


@query("set_fingerprint", "SELECT source, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS fingerprint, count(*) AS n FROM documents GROUP BY 1")
def set_fingerprint(spark, sf_dir):
    return selection.evidence_fingerprint(table(spark, sf_dir, "documents"), "doc_id", ["source"])


@query("safe_names", r"""WITH f AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '[_ ]+', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS s, regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g') AS r FROM pages) SELECT page_id, substr(s, 1, 120) AS file_name, substr(r, 1, 180) AS rel_name FROM f""")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_filename("url").alias("file_name"), text.safe_relname("url").alias("rel_name"))


@query("json_normalise", "SELECT event_id, coalesce(json_extract_string(j, '$.paperId'), '') AS paper_id, coalesce(json_extract_string(j, '$.authors[0].name'), '') AS first_author, 2 AS n_authors, event_id AS citation_count, CASE WHEN event_id % 3 = 0 THEN '10.9/' || event_id ELSE '' END AS doi, 'c' || event_id AS cited FROM (SELECT event_id, '{\"paperId\": \"p' || event_id || '\", \"authors\": [{\"name\": \"A' || user_id || '\"}, \"B\"]}' AS j FROM events)")
def json_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doi = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "externalIds": {"DOI": "10.9/'), "event_id", F.lit('"}'))).otherwise("")
    body = F.concat(F.lit('{"paperId": "p'), "event_id", F.lit('", "authors": [{"name": "A'), "user_id", F.lit('"}, "B"], "citationCount": '), "event_id", doi, F.lit(', "references": [{"citedPaper": {"paperId": "c'), "event_id", F.lit('"}}]}'))
    p = readers.paper_records(e.select(body.alias("json")))
    return p.select(
        F.substring("paper_id", 2, 20).cast("long").alias("event_id"), "paper_id", F.get("authors", F.lit(0)).alias("first_author"), F.size("authors").alias("n_authors"),
        F.col("citation_count").cast("long").alias("citation_count"), "doi", F.get("references", F.lit(0))["paper_id"].alias("cited"),
    )


@query("prompt_build", rf"WITH c AS (SELECT conv_id, turn, role, {STRIP('text')} AS b FROM conversations), s AS (SELECT conv_id, string_agg(b, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system') AS sys, string_agg('[' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE role END || ']' || chr(10) || b, chr(10) ORDER BY turn) FILTER (role <> 'system') AS rest FROM c WHERE b <> '' GROUP BY 1) SELECT conv_id, md5({STRIP('''concat_ws(chr(10) || chr(10), '[System]' || chr(10) || sys, rest)''')}) AS prompt_md5 FROM s")
def prompt_build(spark, sf_dir):
    return models.prompt(table(spark, sf_dir, "conversations")).select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


ANSWER = "CASE doc_id % 5 WHEN 0 THEN 'NO GAPS found' WHEN 1 THEN 'GAPS: ' || substr(lang, 1, 2) || ' | second gap' WHEN 2 THEN 'SEARCH: \"more on ' || source || '\"' WHEN 3 THEN '[' || source || ']' || 'E' ELSE 'Yes, enough' END"


@query("parse_answers", rf"WITH a AS (SELECT doc_id, lang, source, {ANSWER} AS x FROM documents) SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN lang || ';second gap' WHEN doc_id % 5 = 2 AND length(x) > 20 THEN x ELSE '' END AS gaps, CASE WHEN doc_id % 5 IN (0, 1, 3) THEN 'SEARCH' WHEN doc_id % 5 = 2 THEN 'SEARCH' ELSE 'ANSWER' END AS action, CASE WHEN doc_id % 5 = 2 THEN 'more on ' || source WHEN doc_id % 5 = 4 THEN NULL ELSE 'more details' END AS follow_up, CASE WHEN doc_id % 5 = 3 THEN source ELSE x END AS paper, CASE WHEN doc_id % 5 = 3 THEN 'E' ELSE 'M' END AS tag FROM a")
def parse_answers(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id", F.expr(ANSWER.replace("||", "||")).alias("x"))
    d, t = text.parse_decision("x"), text.parse_paper_tag("x")
    return a.select("doc_id", F.array_join(text.parse_gaps("x"), ";").alias("gaps"), d["action"].alias("action"), d["follow_up"].alias("follow_up"), t["paper"].alias("paper"), t["tag"].alias("tag"))


@query("section_extract", "SELECT page_id, i::INT AS n, md5(x) AS header_md5 FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS i, h[k] AS x FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS h FROM pages)))")
def section_extract(spark, sf_dir):
    heads = F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(heads).alias("n", "h")).select("page_id", "n", F.md5(F.col("h").cast("binary")).alias("header_md5"))


@query("url_extract", r"SELECT page_id, array_to_string(list_distinct(regexp_extract_all('See ' || url || ') and ' || url || ' [1]', '(https?://[^\s)\]]+)')), ' ') AS urls FROM pages")
def url_extract(spark, sf_dir):
    md = F.concat(F.lit("See "), "url", F.lit(") and "), "url", F.lit(" [1]"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.source_urls(md), " ").alias("urls"))


@query("report_chunks", "SELECT 'firecrawl://' || substr(sha256(item_id::VARCHAR), 1, 16) || '::chunk' || n AS chunk_id, CASE n WHEN 1 THEN '# One' ELSE '## Two' END AS section_header, length(" + STRIP("text") + ")::INT AS chars FROM benchmark, (VALUES (1), (2)) v(n) WHERE length(" + STRIP("text") + ") >= 30")
def report_chunks(spark, sf_dir):
    md = F.concat(F.lit("# One\n"), "text", F.lit("\n## Two\n"), "text", F.lit("\n### Small\nx"))
    made = readers.report_chunks(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query"), md.alias("markdown")))
    return made.select("chunk_id", "section_header", F.char_length("text").alias("chars"))


@query("topn_report", "SELECT p_name AS title, '- ' || p_name || ' (' || p_size || ') — ' || floor(p_retailprice)::BIGINT || ' citations' AS line FROM part ORDER BY floor(p_retailprice)::BIGINT DESC, p_size DESC, p_name LIMIT 30")
def topn_report(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.floor("p_retailprice").alias("citation_count"), F.col("p_size").cast("double").alias("relevance_score"))
    return readers.top_report(p)


@query("search_stats", "WITH u AS (SELECT min(doc_id) AS d FROM documents GROUP BY substr(text, 1, 80)) SELECT (SELECT count(*) FROM documents) AS raw, count(*) AS unique_papers, count(*) FILTER (d % 2 = 0) AS with_pdf, count(*) FILTER (d % 3 = 0) AS open_access FROM u")
def search_stats(spark, sf_dir):
    """Of the documents as found papers, those with equal titles merged into the first."""
    found = papers(spark, sf_dir).withColumn("is_oa", F.col("ord") % 3 == 0)
    unique = found.groupBy("title").agg(F.min_by(F.struct("pdf_url", "is_oa"), "ord").alias("p")).select("p.*")
    return dedup.search_statistics(found, unique)


API_PAPERS = """
SELECT p_partkey, 'openalex' AS source_api, p_name AS title, 'A ' || p_brand AS first_author, 2 AS n_authors, (1990 + p_size)::INT AS year, p_type AS abstract,
  '10.1/' || p_partkey AS doi, 'W' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN 'oa' || p_partkey ELSE 'pdf' || p_partkey END AS pdf_url,
  p_partkey AS citation_count, p_size % 3 = 0 AS is_oa FROM part
UNION ALL
SELECT p_partkey, 'crossref', CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END, 'B ' || p_brand, 2,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE 1990 + p_size END, '', '10.1/' || p_partkey, 'u' || p_partkey, 'second' || p_partkey, p_partkey, false FROM part
UNION ALL
SELECT p_partkey, 'arxiv', p_name, p_brand, 1, 2000 + p_size % 20, p_type, '', 'http://arxiv.org/abs/' || p_partkey || 'v1',
  CASE WHEN p_size % 2 = 0 THEN 'http://arxiv.org/pdf/' || p_partkey ELSE 'https://arxiv.org/pdf/' || p_partkey || 'v1.pdf' END, 0, true FROM part"""


@query("api_papers", API_PAPERS)
def api_papers(spark, sf_dir):
    """Responses of three APIs, made of every part, as paper rows."""
    p, text_of = table(spark, sf_dir, "part"), lambda *parts: F.concat(*[F.lit(x[1:]) if x.startswith("'") else F.col(x).cast("string") for x in parts])
    key = lambda at: text_of(f"'{at}", "p_partkey")
    access = F.struct((F.col("p_size") % 3 == 0).alias("is_oa"), F.when(F.col("p_size") % 2 == 0, key("oa")).otherwise("").alias("oa_url"), key("pdf").alias("pdf_url"))
    person = lambda name: F.struct(F.struct(name.alias("display_name")).alias("author"))
    work = F.struct(
        F.col("p_name").alias("display_name"), F.array(person(text_of("'A ", "p_brand")), person(F.lit("C"))).alias("authorships"), (1990 + F.col("p_size")).alias("publication_year"),
        F.col("p_type").alias("abstract"), key("https://doi.org/10.1/").alias("doi"), key("W").alias("id"), F.col("p_partkey").alias("cited_by_count"), access.alias("open_access"),
    )
    one = F.to_json(F.struct(F.array(work).alias("results")))
    link = lambda kind, at: F.struct(F.lit(kind).alias("content-type"), key(at).alias("URL"))
    item = F.struct(
        F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name")).alias("title"),
        F.array(F.struct(F.lit("B").alias("given"), F.col("p_brand").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("D").alias("family"))).alias("author"),
        F.when(F.col("p_size") % 5 != 0, F.struct(F.array(F.array(1990 + F.col("p_size"), F.lit(5))).alias("date-parts"))).alias("published-print"),
        key(" 10.1/").alias("DOI"), key("u").alias("URL"), F.col("p_partkey").alias("is-referenced-by-count"),
        F.array(link("text/html", "first"), link("application/PDF", "second"), link("application/pdf", "third")).alias("link"),
    )
    two = F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message")))
    pdf = F.when(F.col("p_size") % 2 == 0, text_of("'<link title=\"pdf\" href=\"http://arxiv.org/pdf/", "p_partkey", "'\"/>")).otherwise("")
    three = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>results</title><entry>'), text_of("'<id>http://arxiv.org/abs/", "p_partkey", "'v1</id><title> ", "p_name", "' </title>"),
        F.lit("<published>"), (2000 + F.col("p_size") % 20).cast("string"), text_of("'-01-02T00:00:00Z</published><summary>\n", "p_type", "'\n</summary><author><name>", "p_brand", "'</name></author>"),
        F.lit('<link rel="alternate" href="x"/>'), pdf, F.lit("</entry></feed>"),
    )
    pages = p.select("p_partkey", one.alias("one"), two.alias("two"), three.alias("three"))
    found = paper_sources.openalex(pages, "one", ("p_partkey",)).unionByName(paper_sources.crossref(pages, "two", ("p_partkey",)))
    found = found.unionByName(paper_sources.arxiv(pages, "three", ("p_partkey",)))
    people = (F.get("authors", F.lit(0)).alias("first_author"), F.size("authors").alias("n_authors"))
    return found.select("p_partkey", "source_api", "title", *people, "year", "abstract", "doi", "url", "pdf_url", "citation_count", "is_oa")


SEARCHED = f"""WITH {EDGES}, s AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 5),
one AS (SELECT rank, dst AS node FROM edge JOIN s ON src = node QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 10),
near AS (SELECT node, min(rank) AS rank FROM one GROUP BY 1),
two AS (SELECT rank, dst AS node FROM edge JOIN near ON src = node QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 10),
back AS (SELECT rank, src AS node FROM edge JOIN s ON dst = node QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= 10),
a AS (SELECT node, 0 AS phase, rank, 0 AS level FROM s UNION ALL SELECT node, 1, rank, 1 FROM one UNION ALL SELECT node, 1, rank, 2 FROM two UNION ALL SELECT node, 2, rank, 1 FROM back)
SELECT node, phase::INT AS phase, rank::INT AS rank, level::INT AS level FROM a QUALIFY row_number() OVER (PARTITION BY node ORDER BY phase, rank, level) = 1"""


@query("search_and_expand", SEARCHED)
def search_and_expand(spark, sf_dir):
    """The five dearest parts as a search's results, with two levels of what they cite and one of what cites them."""
    top = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5)
    found = top.select(F.col("p_partkey").alias("node"), F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"))
    return graph.search_and_expand(edges_of(spark, sf_dir), found, 2, 1)


@query("triple_sources", "SELECT p_partkey, p_brand AS subject, 'comes as' AS predicate, p_name AS object, p_name || ' is ' || p_type AS sentence FROM part WHERE p_partkey % 3 <> 0")
def triple_sources(spark, sf_dir):
    """Annotations made of every part; two of three state the triple."""
    p = table(spark, sf_dir, "part")
    said = F.create_map(F.lit("from sentence"), F.concat(F.lit(" "), "p_name", F.lit(" is "), "p_type"))
    body = F.to_json(F.create_map(F.lit("Contribution"), F.create_map(F.col("p_brand"), F.create_map(F.lit("comes as"), F.create_map(F.col("p_name"), said)))))
    asked = F.when(F.col("p_partkey") % 3 != 0, F.lit("comes as")).otherwise("was")
    rows = p.select("p_partkey", body.alias("json"), F.col("p_brand").alias("subject"), asked.alias("predicate"), F.col("p_name").alias("object"))
    return symbolic.triple_sources(rows, id_col="p_partkey")


@query("node_citations", "SELECT DISTINCT l_suppkey AS node_id, '[' || l_partkey || ']' AS citation FROM lineitem")
def node_citations(spark, sf_dir):
    return tree.node_citations(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@query("node_records", f"WITH {TREE}, k AS (SELECT parent_id AS p, count(*) AS n FROM tr WHERE parent_id IS NOT NULL GROUP BY 1), f AS (SELECT 's' || l_suppkey AS f, count(*) AS m FROM lineitem GROUP BY 1) SELECT node_id AS id, title, 'About ' || title AS description, depth::INT AS depth, coalesce(m, 0) AS facts_count, 'Text of ' || title AS draft_preview, ord % 10 / 10.0::DOUBLE AS confidence, 0.0::DOUBLE AS value, leaf AS is_leaf, ord % 2 = 0 AS is_complete, coalesce(n, 0) AS children_count, parent_id AS parent FROM lf LEFT JOIN k ON p = node_id LEFT JOIN f ON f = node_id")
def node_records(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("node_id"))
    return tree.node_records(tree.add_depth(outline(spark, sf_dir)), facts)


@query("outline_critique", f"WITH {TREE} SELECT node_id, parent_id, ord, title FROM tr UNION ALL SELECT 'root.s' || (row_number() OVER (ORDER BY s) - 1), 'root', (m + row_number() OVER (ORDER BY s))::INT, s FROM (SELECT DISTINCT c_mktsegment AS s FROM customer), (SELECT max(r_regionkey) AS m FROM region)")
def outline_critique(spark, sf_dir):
    """The market segments, which the outline lacks, as further sections."""
    topics = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("title")).distinct()
    nth = F.row_number().over(Window.orderBy("title")) - 1  # a handful of segments
    gaps = topics.select(nth.alias("ord"), "title", F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("keywords"))
    return tree.append_sections(outline(spark, sf_dir), gaps).select("node_id", "parent_id", "ord", "title")


@query("paper_links", "SELECT 'p' || event_id AS paper_id, 0 AS nth, 'c' || event_id AS linked_id, 't' AS title, (event_id % 50)::INT AS year FROM events UNION ALL SELECT 'p' || event_id, 1, 'd' || event_id, '', 0 FROM events")
def paper_links(spark, sf_dir):
    """The first two of the cited papers with an id, of records made of every event."""
    cites = F.concat(F.lit('{"citedPaper": {"paperId": "c'), "event_id", F.lit('", "title": "t", "year": '), F.col("event_id") % 50, F.lit('}}, {"citedPaper": {"title": "none"}}'))
    more = F.concat(F.lit(', {"paperId": "d'), "event_id", F.lit('"}, {"paperId": "e"}]}'))
    body = F.concat(F.lit('{"paperId": "p'), "event_id", F.lit('", "references": ['), cites, more)
    return paper_sources.paper_links(readers.paper_records(table(spark, sf_dir, "events").select(body.alias("json"))), most=2)


RELATED = "SELECT 'p' || event_id AS paper_id, nth::INT AS nth, linked || event_id AS linked_id, title, year::INT AS year FROM events, (VALUES (0, 'a', 't', 1), (1, 'c', '', 0)) v(nth, linked, title, year)"


@query("paper_recommendations", f"{RELATED} WHERE event_id % 2 = 0 AND nth <= event_id % 3")
def paper_recommendations(spark, sf_dir):
    """One to three recommended papers of every event, for half of which a response is in the cache; one of its three has no id."""
    events = table(spark, sf_dir, "events")
    asked = events.select(F.concat(F.lit("p"), "event_id").alias("paper_id"), (F.col("event_id") % 3 + 1).cast("int").alias("limit"))
    body = F.concat(F.lit('{"papers": [{"paperId": "a'), "event_id", F.lit('", "title": "t", "year": 1}, {"title": "none"}, {"paperId": "c'), "event_id", F.lit('"}]}'))
    name = F.concat(F.lit("p"), "event_id", F.lit(":"), (F.col("event_id") % 3 + 1).cast("string"))
    cache = events.where("event_id % 2 = 0").select(text.cache_key(F.lit("related"), name).alias("key"), body.alias("body"))
    return paper_sources.recommendations(asked, cache)


def reasoned(spark, sf_dir) -> reasoning.Reasoning:
    """All documents as papers, their triples resolved, events as information units and benchmark items as sections."""
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    triples, terms = triples_of(spark, sf_dir)
    units = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("unit_type"))
    sections = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("section_id"), F.col("text").alias("title"))
    whole = lambda p: p.select("paper_id", scores.primary_tag("text", KEYWORDS).alias("tag"), "text")
    return reasoning.reason(papers, triples, units, terms, sections, segment=whole)


RELATED = f"""{WORDS}, {TAGGED}, ky AS (SELECT s || '||' || p || '||' || o AS key, doc_id FROM tp), hub AS (SELECT key, min(doc_id) AS hub FROM ky GROUP BY 1),
pr AS (SELECT hub, doc_id, string_agg(key, ';' ORDER BY key) AS evidence FROM ky JOIN hub USING (key) WHERE doc_id <> hub GROUP BY ALL),
rl AS (SELECT hub::VARCHAR AS from_paper, a.tag AS from_tag, pr.doc_id::VARCHAR AS to_paper, b.tag AS to_tag, 'supports' AS relation, evidence FROM pr JOIN tg a ON a.doc_id = hub JOIN tg b ON b.doc_id = pr.doc_id)"""


@query("symbolic_relationships", f"WITH {RELATED} SELECT * FROM rl")
def symbolic_relationships(spark, sf_dir):
    return reasoned(spark, sf_dir).relationships.drop("explanation").withColumn("evidence", F.array_join("evidence", ";"))


@query("symbolic_selections", f"WITH {RERANK}, qt AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM q), dt AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2))) AS t FROM documents), s AS (SELECT item_id AS section_id, doc_id AS paper_id, count(*)::DOUBLE / any_value(n) AS score FROM qt JOIN dt USING (t) GROUP BY ALL) SELECT section_id, paper_id, round(score, 9) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY score DESC, paper_id) AS rank FROM s) WHERE rank <= 5")
def symbolic_selections(spark, sf_dir):
    return reasoned(spark, sf_dir).selections.select("section_id", "paper_id", F.round("score", 9).alias("score"), "rank")


RESOLVED = "e AS (SELECT doc_id, (i - 1) // 10 AS s, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM tp)), nn AS (SELECT tp.doc_id, count(DISTINCT e.s) AS n FROM tp JOIN e ON e.doc_id = tp.doc_id AND e.t IN (tp.s, tp.p, tp.o) GROUP BY 1)"


@query("symbolic_stats", f"WITH {RELATED}, {RESOLVED} SELECT (SELECT count(*) FROM documents) AS papers, (SELECT count(*) FROM tg) AS total_segments, (SELECT count(*) FROM tp) AS total_triples, (SELECT count(*) FROM tp LEFT JOIN nn USING (doc_id) WHERE CASE WHEN c >= 3 THEN c ELSE least(coalesce(n, 0), 2) END >= 2) AS fully_resolved_triples, (SELECT count(*) FROM events) AS total_info_units, (SELECT count(*) FROM rl) AS relationships, (SELECT count(*) FROM benchmark) AS sections")
def symbolic_stats(spark, sf_dir):
    return reasoned(spark, sf_dir).stats


#: What stands for verbs and function words in the invented prose.
VERBS = ["is", "was", "be", "est", "ist", "es", "shat", "thing"]
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "that", "it", "with", "le", "la", "de", "et", "der", "die", "und", "el", "los", "que"]
_WORDS = lambda ws: ", ".join(f"'{w}'" for w in ws)
PLAIN = HEADED.replace("CASE WHEN i % 4 = 0 THEN (i // 4)::VARCHAR || '. Section Heading' ELSE p[i] END AS raw", "p[i] AS raw")
PARTS = rf"""{PLAIN},
bd AS (SELECT doc_id, part, coalesce(max(line) FILTER (head), '') AS heading, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT head) AS body FROM p GROUP BY doc_id, part HAVING count(*) FILTER (NOT head) > 0),
bs AS (SELECT doc_id, heading, string_split(body, '. ') AS ps, coalesce(sum(len(string_split(body, '. '))) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM bd),
ps AS (SELECT doc_id, heading, (first + i - 1)::INT AS sentence_idx, {STRIP("ps[i]")} AS text FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM bs)),
tk AS (SELECT doc_id, heading, sentence_idx, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}%][\p{{L}}\p{{N}}%''-]*|[,;:()\[\].!?]') AS ts FROM ps WHERE text <> '')"""
KIND = f"CASE WHEN regexp_matches(w, '^[,;:()\\[\\].!?]$') THEN 'B' WHEN lower(w) IN ({_WORDS(VERBS)}) THEN 'V' WHEN lower(w) IN ({_WORDS(FUNCTION_WORDS)}) THEN 'D' ELSE 'N' END".replace("\\\\", "\\")
CHUNKED = "((?:N:[^ ]+ )+)(?:D:[^ ]+ )*((?:V:[^ ]+ )+)(?:D:[^ ]+ )*((?:N:[^ ]+ )+)"
TRIPLES = rf"""{PARTS},
an AS (SELECT doc_id, heading, sentence_idx, array_to_string(list_transform(ts, lambda w: {KIND} || ':' || w || ' '), '') AS a FROM tk),
ex AS (SELECT doc_id, heading, sentence_idx, regexp_extract_all(a, '{CHUNKED}', 1) AS s, regexp_extract_all(a, '{CHUNKED}', 2) AS p, regexp_extract_all(a, '{CHUNKED}', 3) AS o FROM an),
tx AS (SELECT doc_id, heading, sentence_idx, i - 1 AS nth, {", ".join(f"trim(regexp_replace({c}[i], '[NV]:', '', 'g')) AS {n}" for c, n in (("s", "subject"), ("p", "predicate"), ("o", "object")))}
  FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM ex))"""


@query("triple_extract", f"WITH {TRIPLES} SELECT doc_id AS paper_id, sentence_idx, nth::INT AS nth, subject, predicate, object, 'Contribution' AS info_unit, 3 AS completeness FROM tx")
def triple_extract(spark, sf_dir):
    """The triples that the sentences of all documents state."""
    return extraction.extract_triples(table(spark, sf_dir, "documents"), verbs=f"^({'|'.join(VERBS)})$", function_words=FUNCTION_WORDS)


PHRASES = rf"""{PARTS},
rn AS (SELECT doc_id, sentence_idx, list_filter(list_transform(string_split(array_to_string(list_transform(ts, lambda w: CASE WHEN {KIND.replace("'V'", "'N'")} = 'N' THEN lower(w) ELSE '|' END), ' '), '|'), lambda r: trim(r)), lambda r: r <> '') AS r FROM tk WHERE length(text) > 10),
ph AS (SELECT doc_id, sentence_idx, i AS nth, r[i] AS phrase, string_split(r[i], ' ') AS ws FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM rn) WHERE len(string_split(r[i], ' ')) <= 4),
wd AS (SELECT doc_id, sentence_idx, nth, phrase, len(ws) AS n, unnest(ws) AS w FROM ph),
sc AS (SELECT doc_id, w, sum(n)::DOUBLE / count(*) AS score FROM wd GROUP BY ALL),
fs AS (SELECT doc_id, sentence_idx, phrase, nth, round(sum(score), 9) AS score FROM wd JOIN sc USING (doc_id, w) GROUP BY ALL),
best AS (SELECT doc_id, sentence_idx, phrase, max(score) AS score, min(nth) AS nth FROM fs GROUP BY doc_id, sentence_idx, phrase QUALIFY row_number() OVER (PARTITION BY doc_id, sentence_idx ORDER BY max(score) DESC, min(nth)) <= 5)"""


@query("key_phrases", f"WITH {PHRASES} SELECT doc_id, sentence_idx, string_agg(phrase, ';' ORDER BY score DESC, nth) AS phrases FROM best GROUP BY ALL")
def key_phrases(spark, sf_dir):
    """The key phrases of every sentence of all documents."""
    cut = extraction.paragraph_sentences(table(spark, sf_dir, "documents")).where(F.char_length("text") > 10)
    told = extraction.sentence_phrases(cut, function_words=FUNCTION_WORDS, dealt=True)
    return told.select("doc_id", "sentence_idx", F.array_join("key_phrases", ";").alias("phrases"))


def leaf_tables(spark, sf_dir):
    """Benchmark items as the leaves of an outline, documents as chunks of an index."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("node_id"), F.col("text").alias("title"))
    docs = table(spark, sf_dir, "documents")
    return items, docs.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_ord"), "text", models.HashEmbedder().embed(F.col("text")).alias("embedding"))


LEAF_FACTS = rf"""{HASHED}, {RERANK},
nr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5),
m AS (SELECT doc_id, text FROM documents), sn AS (SELECT * FROM ({SENTENCES.removeprefix("s AS ")})),
ff AS (SELECT query_id, doc_id, rank, n, x, round(len(list_filter(w, lambda t: contains(lower(x), t)))::DOUBLE / len(w), 9) AS score FROM nr JOIN q ON item_id = query_id JOIN sn USING (doc_id) WHERE length(x) > 20 AND len(w) > 0),
fo AS (SELECT query_id, doc_id, x, min(score) AS score, min((rank, n)) AS place FROM ff WHERE score > 0 GROUP BY ALL)"""


@query("leaf_facts", f"WITH {LEAF_FACTS} SELECT query_id AS node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, doc_id, x)::INT AS fact_ord, md5(x) AS text_md5, doc_id AS source_doc, score FROM fo QUALIFY fact_ord <= 12")
def leaf_facts(spark, sf_dir):
    """The facts of every leaf from its five nearest documents."""
    items, docs = leaf_tables(spark, sf_dir)
    found = leaves.leaf_facts(leaves.leaf_evidence(leaves.leaf_queries(items), docs, 5, scorer=None, tie="document_id"))
    return found.select("node_id", "fact_ord", F.md5(F.col("text").cast("binary")).alias("text_md5"), "source_doc", "score")


@query("leaf_drafts")
def leaf_drafts(spark, sf_dir):
    """Every leaf of the benchmark's outline, processed to its draft and confidence."""
    items, docs = leaf_tables(spark, sf_dir)
    return leaves.process_leaves(items, docs, tie="document_id").nodes.drop("chosen")
