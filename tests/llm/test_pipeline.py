"""run() against a plain version of its stages."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline

from .test_native import fill
from .test_texts import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    best = {}
    for r in rows:
        key = r["text"].translate(LOWER)
        best[key] = max(best.get(key, -1), r["doc_id"])
    rows = [r for r in rows if best[r["text"].translate(LOWER)] == r["doc_id"]]
    part = components({r["doc_id"]: r["text"] for r in rows})
    rows = [r for r in rows if part[r["doc_id"]][1] == r["doc_id"]]
    size = {r["doc_id"]: len(r["text"].split()) for r in rows}
    total = Counter()
    for r in rows:
        total[r["source"]] += size[r["doc_id"]]
    target, out = fill(dict(total)), []
    for source in total:
        start = 0
        for r in sorted((r for r in rows if r["source"] == source), key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()):
            out += [r for e in range(3) if start + e * total[source] + size[r["doc_id"]] / 2 <= target[source]]
            start += size[r["doc_id"]]
    return out


def test_run(spark, tmp_path):
    source = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(source)
    more = spark.createDataFrame([(5001, None, "en", "src1", 0), (5002, "", "en", "src1", 0), (5003, "12 34", "en", "src1", 5), (5004, docs.first()["text"].upper(), "fr", "src1", 1)], docs.schema)
    docs, more = (x.selectExpr("*", "0.5D AS score", "'mine' AS lang_pred") for x in (docs, more))  # names that the stages use
    docs.union(more).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r["doc_id"], hashlib.sha256(" ".join(map(str, library.encode_ordinary(r["text"]))).encode()).hexdigest()) for r in plain([r.asDict() for r in docs.union(more).collect()]))
    got = Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    known = corpus_pipeline.known_language(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").collect()
    assert {(r["score"], r["lang_pred"]) for r in known} == {(0.5, "mine")} and all(r["lang"] for r in known)
    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_the_language_stage_rejects_and_fills_in(spark):
    """Texts that could be any of five languages are rejected; where none is named the predicted one is put in; clean rows stay."""
    rng = random.Random(2)
    alphabets = {"xa": "abcd", "xb": "efgh", "xc": "ijkl", "xd": "mnop", "xe": "qrst"}
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(3, 7)))
    text = lambda lang: " ".join(word(alphabets[lang]) for _ in range(30))
    rows = [(i, text(lang), lang, "s", 1) for i in range(300) for lang in [rng.choice(list(alphabets))]]
    unnamed = [(1000 + i, text("xc"), None, "s", 1) for i in range(20)]
    mixed = [(2000 + i, " ".join(word(alphabets[lang]) for _ in range(8) for lang in alphabets), None, "s", 1) for i in range(20)]
    strange = [(3000 + i, "".join(rng.choices("\u05d0\u05d1\u05d2\u05d3", k=60)), None, "s", 1) for i in range(20)]
    docs = spark.createDataFrame(rows + unnamed + mixed + strange, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert all(got.get(r[0]) == r[2] for r in rows) and all(got.get(r[0]) == "xc" for r in unnamed)
    assert sum(r[0] in got for r in strange) == 0 and sum(r[0] in got for r in mixed) < 10
