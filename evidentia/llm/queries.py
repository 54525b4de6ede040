"""One query for each operator of this subpackage over its whole table, and DuckDB SQL where that can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, exact_dedup, langid, line_dedup, mixing, negatives, ngram_join, quality, sharding, spelling, url_filter

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PROBE = "\\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
made AS (SELECT *, '### ' || url_encode(role) || chr(10) || replace(replace(replace(text, '\', '\s'), '###', '\h\h\h'), '</turn>', '\l/turn>') || chr(10) || '</turn>' || chr(10) AS made FROM src),
tok AS (SELECT *, len(regexp_extract_all(made, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS tokens FROM made),
num AS (SELECT *, row_number() OVER w - 1 AS pos, sum(tokens) OVER w - tokens AS start FROM tok
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
sys AS (SELECT conv_id, role, made, tokens FROM num WHERE pos = 0 AND role = 'system'),
past AS (SELECT n.*, coalesce(s.tokens, 0) AS system, greatest(0, least(256, 1024 - coalesce(s.tokens, 0) - 128)) AS past FROM num n LEFT JOIN sys s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
half AS (SELECT *, floor(greatest(1, 1024 - system - past) / 2.0) AS half FROM past),
cell AS (SELECT *, floor(start / greatest(half, 1)) AS cell, (tokens > half)::INT AS own FROM half),
sub AS (SELECT *, 2 * sum(own) OVER (PARTITION BY conv_id, cell ORDER BY pos ROWS UNBOUNDED PRECEDING) - own AS sub FROM cell),
spans AS (SELECT conv_id, cell, sub, min(pos) AS first, min(start) AS begin, any_value(past) AS past FROM sub GROUP BY ALL),
parts AS (
  SELECT conv_id, made FROM sub
  UNION ALL SELECT h.conv_id, h.made FROM spans p JOIN sub h ON h.conv_id IS NOT DISTINCT FROM p.conv_id AND h.pos BETWEEN p.first - 2 AND p.first - 1 AND p.begin - h.start <= p.past
    WHERE NOT (h.pos = 0 AND h.role = 'system')
  UNION ALL SELECT s.conv_id, s.made FROM spans p JOIN sys s ON s.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.first > 0),
chars AS (SELECT conv_id, sum(length(made))::BIGINT AS formatted_chars FROM parts GROUP BY 1),
whole AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss FROM num GROUP BY 1)
SELECT w.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM whole w JOIN chars c ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op1_chat_windows", CHAT_SQL)
def op1(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE))
    return chat.read_back(chat.format_windows(given.union(probe))).withColumnRenamed("conv", "conv_id")


DEDUP_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (t)
"""


@query("op2_exact_dedup", DEDUP_SQL)
def op2(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("bucket", "chain")


MIX_SQL = r"""
WITH n AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM n GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM src),
c AS (SELECT *, (nth - 1) % 3 + 1 AS weight, source_size * 3 AS cap, (source_size * 3)::DOUBLE / ((nth - 1) % 3 + 1) AS level FROM w),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY level, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
  (sum(weight) OVER (ORDER BY level, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open FROM c),
f AS (SELECT level AS l, nth AS m, rest, open FROM o WHERE level >= rest / open ORDER BY level, nth LIMIT 1),
t AS (SELECT o.source, o.source_size, o.nth, CASE WHEN f.l IS NULL OR (o.level, o.nth) < (f.l, f.m) THEN cap::DOUBLE ELSE f.rest / f.open * weight END AS target FROM o LEFT JOIN f ON true),
p AS (SELECT n.doc_id, n.size, t.*, (sum(size) OVER (PARTITION BY n.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source),
r AS (SELECT doc_id, size, source_size, target, start, CASE WHEN nth % 2 = 1 THEN 1.5::DOUBLE ELSE 0.5 END AS a, unnest([0, 1, 2]) AS e,
  least(size, greatest(0, floor(target)::BIGINT - start - e * source_size)) AS got FROM p),
q AS (SELECT *, CASE WHEN got > 0 THEN round((sqrt(a * a + 2 * (2 - 2 * a) * ((start + e * source_size) / target)) - a) / (2 - 2 * a), 9) + 0.0 END AS t FROM r)
SELECT doc_id, size, source_size, target, sum(got)::BIGINT AS taken, count(*) FILTER (size > 0 AND got = size)::INT AS copies,
  min(t) AS first_position, max(t) AS last_position
FROM q GROUP BY doc_id, size, source_size, target, start
"""


@query("op3_curriculum_mix", MIX_SQL)
def op3(spark, sf_dir):
    return mixing.schedule(table(spark, sf_dir, "documents")).drop("positions")


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op5_byte_bpe")
def op5(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())


@query("op6_byte_shards")
def op6(spark, sf_dir):
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


NGRAM_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(seen) AS c FROM r GROUP BY 1) m ON m.node = w.doc_id
"""


@query("op9_ngram_jaccard", NGRAM_SQL)
def op9(spark, sf_dir):
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


@query("op4_language_id")
def op4(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op8_multi_index_neighbours")
def op8(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"))


def url_sql() -> str:
    """The query's rules; the walks of each length up to 250 links, beyond which they weigh under 1e-17, as a recursion."""
    rules = [(r.text, r.verdict, f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')") for r in sorted(url_filter.RULES, key=lambda r: -len(r.text))]
    pick = lambda i: "CASE " + " ".join(f"WHEN {r[2]} THEN '{r[i]}'" for r in rules) + " END"
    d = url_filter.DAMPING
    return f"""
WITH RECURSIVE u AS (SELECT page_id, html, strpos(coalesce(url, ''), '://') > 0 AS ok, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS MATERIALIZED (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
told AS (SELECT page_id, host, path, {pick(0)} AS rule, {pick(1)} AS verdict FROM p),
link AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\\s"''>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p),
up AS (SELECT DISTINCT host AS src, regexp_replace(host, '^[^.]*[.]', '') AS dst FROM p WHERE len(string_split(host, '.')) > 3),
edge AS MATERIALIZED (SELECT src, dst, sum(w)::DOUBLE AS weight FROM (SELECT src, dst, 1 AS w FROM link WHERE src <> '' AND src <> dst UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) GROUP BY ALL),
both_ways AS (SELECT 'allow' AS kind, src, dst, weight FROM edge UNION ALL SELECT 'block', dst, src, weight FROM edge),
share AS MATERIALIZED (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM both_ways),
n AS (SELECT verdict AS kind, host, count(*)::DOUBLE AS n FROM told WHERE rule IS NOT NULL GROUP BY ALL),
seed AS MATERIALIZED (SELECT kind, host, n / sum(n) OVER () AS seed FROM n),
walk AS (SELECT kind, host, seed * (1 - {d}::DOUBLE) AS step, 0 AS n FROM seed
  UNION ALL SELECT e.kind, e.dst, sum(w.step * e.share * {d}), max(w.n) + 1 FROM walk w JOIN share e ON w.kind = e.kind AND w.host = e.src WHERE w.n < 250 GROUP BY e.kind, e.dst),
h AS (SELECT host, coalesce(sum(step) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(step) FILTER (kind = 'block'), 0) AS distrust FROM walk GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {url_filter.RATIO}::DOUBLE * (1 + {url_filter.MARGIN}::DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict
FROM told LEFT JOIN h USING (host)
"""


@query("op10_url_link_graph", url_sql())
def op10(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op7_fuzzy_lines")
def op7(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    return spelling.group_variants(spelling.vocabulary(spelling.occurrences(table(spark, sf_dir, "documents"))))


QUALITY_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS host, source IS NULL AS nohost, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS g, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
raw AS (SELECT doc_id, host, nohost, t, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
ln AS MATERIALIZED (SELECT doc_id, host, nohost, t, trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS l FROM raw),
hosts AS (SELECT host, nohost, count(DISTINCT t) AS docs FROM d GROUP BY ALL),
common AS (SELECT host, nohost, l FROM ln JOIN hosts USING (host, nohost) WHERE l <> '' GROUP BY host, nohost, l, docs HAVING count(DISTINCT t) > {quality.LINE_DOCS} AND count(DISTINCT t) > {quality.LINE_SHARE} * docs),
gone AS (SELECT doc_id, sum(len(string_split(l, ' '))) AS n FROM ln JOIN common USING (host, nohost, l) GROUP BY 1),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR n_words - n_removed_words < {quality.LEAST_LEFT} * n_words)) AS kept FROM b
"""


@query("op12_line_quality", QUALITY_SQL)
def op12(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


NEGATIVES_SQL = """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return negatives.mine(rows.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")), F.col("vec_id") % 50 == 0)
