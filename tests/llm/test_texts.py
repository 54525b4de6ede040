"""Language ID, byte-level BPE, line dedup and n-gram join against plain versions."""

import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from evidentia.llm import bpe, common, langid, line_dedup, ngram_join
from evidentia.llm import shingles as shingles_
from evidentia.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, n long, key string"


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    for few in (0, 1000):  # by joins, in one task
        given = spark.createDataFrame(edges, "a long, b long").repartition(5)
        got = {r["node"]: r["component"] for r in connected_components(given, few=few).collect()}
        assert all(label[n] == c for n, c in got.items()) and {n for e in edges for n in e if e[0] != e[1]} == set(got)
        assert connected_components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_language_id(spark):
    rng = random.Random(5)
    alphabet = {"xa": ["ba", "bo", "ti"], "xb": ["ga", "zo", "ki"], "xc": ["ла", "мо", "ба"]}
    text = lambda lang: " ".join("".join(rng.choices(alphabet[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 60)))
    rows = [(i, text(lang := rng.choice(list(alphabet))), lang, 0, "k") for i in range(400)]
    rows += [(1000, None, "xa", 0, "k"), (1001, "123 !!", "xa", 0, "k"), (1002, "", None, 0, "k"), (1003, text("xb") * 3000, None, 0, "k"), (None, text("xa"), "xa", 0, "k"), (5, text("xa"), "xa", 0, "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lang_pred"] == "xb"
    told = {r[0]: r[2] for r in rows[:400]}
    held = [r for r in got if r["held_out"] and r["doc_id"] in told]
    assert len(held) > 50 and sum(r["lang_pred"] == told[r["doc_id"]] for r in held) / len(held) > 0.95
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_a_text_is_read_whole_in_pieces():
    text = "Ab c-Dé " * 1000
    whole = langid.gram_counts(text)
    old, langid.PIECE = langid.PIECE, 101
    try:
        assert (langid.gram_counts(text) == whole).all()
    finally:
        langid.PIECE = old


def test_bpe_equals_the_library(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab eé\n\t  '.st1!<|中\U0001f600\x85 ", k=rng.randint(0, 80))) for _ in range(300)]
    texts += [None, "", "<|endoftext|>", "x" * 5000, "the quick " * 40_000, "don't\u2028stop   \n\n now"]
    df = spark.createDataFrame([(i, t, None, 0, "k") for i, t in enumerate(texts)], SCHEMA)
    for r in bpe.round_trip(df, path, P.PATTERN).collect():
        t = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    coded = bpe.decode(bpe.encode(df, path, P.PATTERN), path).select("text", "ids", "decoded").collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") and r["ids"] == library.encode_ordinary(r["text"] or "") for r in coded)
    assert bpe.round_trip(df.limit(0), path, P.PATTERN).count() == 0


def test_perfect_hash():
    keys = [str(i).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert [h.find(k) for k in keys] == list(range(3000)) and sorted(h.items) == list(range(3000)) and h.find(b"none") is None


def shingles(text, k=5):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_words_decide_links(spark):
    """Thue-Morse words and their complements collide under polynomial hashes; words that differ in any one place don't count as equal."""
    thue = ["".join("ab"[(bin(i).count("1") + c) % 2] for i in range(n)) for n in (64, 1024, 4096) for c in (0, 1)]
    texts = thue + ["a" * 70 + c for c in "bcd"] + ["one two three four", "one two  THREE four", "one two three"]
    docs = spark.createDataFrame([(i, t, None, 0, "k") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs).collect()}
    assert got == {i: i for i in range(len(texts))} | {10: 9}
    assert {r["doc_id"] for r in ngram_join.keep_one(docs).collect()} == set(range(len(texts))) - {10}
    h = [shingles_.word_hashes(t)[0] for t in texts[:9]]
    assert len(set(h)) == 9 and (shingles_.word_hashes(" ".join(texts)) == [x for t in texts for x in shingles_.word_hashes(t)]).all()


def test_keep_one_of_repeated_rows(spark):
    """Rows that repeat an id and its text but differ elsewhere: one stays; without words all do."""
    docs = spark.createDataFrame([(1, "a b c d e f g", "x", i, "k") for i in range(40)] + [(2, " \n", "x", i, "k") for i in range(3)] + [(3, None, "x", i, "k") for i in range(2)], SCHEMA)
    got = ngram_join.keep_one(docs).groupBy("doc_id").count().collect()
    assert {(r["doc_id"], r["count"]) for r in got} == {(1, 1), (2, 3), (3, 2)}


def test_ngram_join_equals_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=60)
    texts = {}
    for g in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 6, 12, 20, 60, 150]))
        if g % 3 == 0:
            base = passage + base[: rng.randint(0, 25)]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[len(texts)] = rng.choice([" ", "\t", " \n"]).join(w.upper() if rng.random() < 0.1 else w for w in words)
    texts |= {len(texts) + i: t for i, t in enumerate([None, "", "  ", "one", "One", "ÄB c", "äb c", texts[0], texts[1]])}
    df = spark.createDataFrame([(i, t, None, 0, "k") for i, t in texts.items()], SCHEMA)
    want = components(texts)
    old = ngram_join.FREQUENT
    try:
        for frequent in (10, 3):  # few and many frequent tokens: results don't depend on it
            ngram_join.FREQUENT = frequent
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()}
            assert got == want
    finally:
        ngram_join.FREQUENT = old
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (n, c) in want.items() if n == 0 or i == c)
    assert ngram_join.ngram_components(df.limit(0)).count() == 0


def test_ngram_join_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f", None, 0, ""), (1, "a b c d e f", None, 0, ""), (None, "A b c d e f", None, 0, ""), (1, "something else in here now", None, 0, ""), (None, None, None, 0, "")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (1, 1, 1), (None, 0, None)], key=str)


def test_line_dedup(spark):
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    near = line(40)
    hot = line(8)
    texts = [line(12) + "\n" + near + "\n\nshort", near.upper() + "\nshort\n" + line(9), near[:-3] + "xyz\n" + hot, None, "", hot + "\n" + hot, "  \n\t", " short ", line(20_000)]
    df = spark.createDataFrame([(i, t, None, 0, "k") for i, t in enumerate(texts)] + [(0, texts[0], None, 0, "k")], SCHEMA)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert [got[i]["n_dropped"] for i in range(9)] == [0, 2, 1, 0, 0, 2, 0, 1, 0]
    assert got[0]["text"] == texts[0] and got[2]["text"] == hot and got[3]["text"] is None and got[5]["text"] == "" and got[1]["text"] == texts[1].split("\n")[2]
    assert line_dedup.dedup_lines(df).count() == 10 and line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_links_equal_all_pairs(spark):
    rng = random.Random(10)
    base = ["".join(rng.choices("abcdefghij ", k=rng.choice([8, 60, 200]))).strip() or "x" for _ in range(15)]
    lines = []
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = rng.choice("abcdefghij")
            lines.append("".join(c))
    norm = [line_dedup.normal_lines(x)[0] for x in lines]
    sets = [line_dedup.shingle_strings(x) for x in norm]
    label = list(range(len(lines)))
    for _ in range(len(lines)):
        for i in range(len(lines)):
            for j in range(i):
                if line_dedup.similar(sets[i], sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[i] == label[j] for i in range(len(lines)) for j in range(i) if line_dedup.similar(sets[i], sets[j])):
            break
    df = spark.createDataFrame([(i, t, None, 0, "k") for i, t in enumerate(lines)], SCHEMA)
    want = {i for i in range(len(lines)) if label[i] == i or not norm[i]}
    old = common.BLOCK
    for block, parts in ((old, 1), (4, 7)):  # neither the size of blocks nor the partitioning changes anything
        try:
            common.BLOCK = block
            got = line_dedup.dedup_lines(df.repartition(parts)).collect()
        finally:
            common.BLOCK = old
        assert {r["doc_id"] for r in got if r["n_dropped"] == 0} == want
