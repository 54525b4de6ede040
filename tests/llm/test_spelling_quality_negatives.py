"""Spelling variants, quality rules and hard negatives against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidentia.llm import negatives, quality, spelling

DOCS = "doc_id long, text string, source string, n long, word string, key string, row long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda x: (-n[x], x), default=None)
        if top is not None and n[top] >= 10 * n[w]:
            form[w] = top
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def test_spelling_variants_equal_a_plain_version(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abÀàZé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["x" * 40_000, "x" * 40_001, "x" * 39_998 + "yx"]
    words += [w[:i] + rng.choice("abq") + w[i + rng.randint(0, 1) :] for w in words[:60] for i in (0, 3, len(w))]
    words += ["receive", "recieve", "receives", "receivee", "receiveee"]
    weight = [rng.choice((1, 2, 12, 150)) for _ in words]
    weight[60:63], weight[-5:] = [40, 3, 2], [1500, 2, 40, 90, 6]
    bag = [w for w, k in zip(words, weight) for _ in range(k)]
    rng.shuffle(bag)
    rows = [(i, " ".join(bag[i * 40 : i * 40 + 40]), "s", 1, "w", "k", 2) for i in range(len(bag) // 40 + 1)]
    rows += [(None, "receive; receive\n-receive", None, 1, "w", "k", 2), (None, None, None, 1, "w", "k", 2), (7, "", "s", 1, "w", "k", 2)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(plain_variants(rows), key=repr)
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)
    for most in (spelling.MOST, 3):  # also with every list dealt again
        got = spelling.group_variants(spelling.vocabulary(spelling.occurrences(docs)), most=most).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert spelling.group_variants(spelling.vocabulary(spelling.occurrences(docs.limit(0)))).count() == 0


def test_search_of_sorted_lists():
    rng = random.Random(3)
    for _ in range(100):
        lists = [sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 30))}) for _ in range(3)]
        rests, lo, hi, want = [], [], [], set()
        for each in lists:
            at = len(rests)
            lo += [at] * len(each)
            hi += [at + len(each)] * len(each)
            want |= {(at + i, at + j) for i, a in enumerate(each) for j, b in enumerate(each) if a != b and one_edit(a, b)}
            rests += each
        i, j = spelling.near_in_lists(np.array(lo), np.array(hi), rests)
        found = list(zip(i.tolist(), j.tolist()))
        assert len(found) == len(set(found)) and set(found) == want


def test_lists_stay_short(spark):
    """A prefix and a suffix that all words share: no list stays over the limit."""
    words = sorted({"aaaa" + "".join(p) + "zzzz" for p in ((x, y, z) for x in "abcdefgh" for y in "abcdefgh" for z in "abcdefgh")})
    vocab = spark.createDataFrame([(i, w, 2) for i, w in enumerate(words)], "id long, word string, n long")
    longest = spelling.lists(vocab, 20).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert longest <= 20
    got = {r["word"]: r["n_near"] for r in spelling.group_variants(vocab, most=20).collect()}
    assert got == {w: 21 for w in words}


SPACE = r"[^\x20\x09-\x0D]+"


def plain_quality(rows):
    lines_of, texts = defaultdict(set), defaultdict(set)
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.translate(LOWER)).strip(" ")
    for _, text, host, *_ in rows:
        texts[host].add(text or "")
        for line in {norm(x) for x in (text or "").split("\n")} - {""}:
            lines_of[host, line].add(text or "")
    out = []
    for doc_id, text, host, *_ in rows:
        words = re.findall(SPACE, text or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = len({i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)})
        lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
        failed = len(words) < 10 or 100 * repeated > 20 * len(words)
        gone = sum(len(re.findall(SPACE, x)) for x in lines if len(lines_of[host, norm(x)]) > max(10, 0.01 * len(texts[host])))
        left = len(words) - gone
        out.append((
            doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated,
            failed, not failed and not (gone and (left < 10 or left < 0.3 * len(words))), gone,
        ))
    return out


def quality_rows():
    rng = random.Random(2)
    some = lambda k: " ".join("".join(rng.choice("abcdeé#|") for _ in range(rng.randint(1, 6))) for _ in range(k))
    rows = []
    for i in range(400):
        host = ("a", "b", None)[i % 7 % 3]
        text = "\n".join(some(rng.randint(3, 14)) for _ in range(rng.randint(1, 4)))
        if i % 3 == 0:
            text += "\nAll  rights reserved by the\tpublisher of this\x0bpage and its many friends everywhere in the world"
        if i % 9 == 0:
            text = "all rights reserved by the publisher of this page and its many friends everywhere in the world\r\n" + some(2)
        if i % 11 == 0:
            text += "\n" + "\n".join([some(6)] * 3)
        rows.append((i, text, host, 1, "w", "k", i))
    rows += [(1000 + i, "a copied text of more than ten words that stays, as its copies count for one document", "a", 1, "w", "k", 0) for i in range(60)]
    rows += [rows[3], rows[3], (None, rows[5][1], None, 1, "w", "k", 0), (2000, None, "a", 1, "w", "k", 0), (2001, "", None, 1, "w", "k", 0), (2002, " \n\t", "b", 1, "w", "k", 0)]
    rows += [(2003, "w " * 30_000, "b", 1, "w", "k", 0), (2004, "\n".join(some(9) for _ in range(3000)), "b", 1, "w", "k", 0), (2005, "a b c d e a b c d e f", "b", 1, "w", "k", 0)]
    return rows


def test_quality_equals_a_plain_version(spark, monkeypatch):
    rows = quality_rows()
    want = sorted(plain_quality(rows), key=repr)
    assert any(not r[6] and not r[7] for r in want) and any(r[8] and r[7] for r in want)
    docs = spark.createDataFrame(rows, DOCS)
    for narrow in (quality.NARROW, 0):  # removed lines broadcast, and dealt
        monkeypatch.setattr(quality, "NARROW", narrow)
        got = quality.judge(docs).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_has_no_python(spark):
    plan = quality.judge(spark.createDataFrame(quality_rows()[:20], DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


V = "vec_id long, embedding array<double>, label int, q int, norm double, block int"


def plain_negatives(rows, positives=5, kept=3):
    seen = {}
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * x)) for x in v]
        if sum(x * x for x in q) >= 1 << 62:
            continue
        seen[vec_id] = min(seen.get(vec_id, (label, q)), (label, q))
    dims = Counter(len(q) for _, q in seen.values())
    dims = min(dims, key=lambda d: (-dims[d], d), default=0)
    seen = {i: r for i, r in seen.items() if len(r[1]) == dims}
    out = []
    for a, (label, q) in seen.items():
        if a % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, r)), i, other) for i, (other, r) in seen.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            found = [(-n, i) for n, i, other in scores if other != label and 50 * -s <= 100 * -n <= 95 * -s][:kept]
            out += [(a, p, rank, i, -s, n) for rank, (n, i) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_hard_negatives_equal_a_plain_version(spark, monkeypatch, scale):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 12))
    x = (centres[rng.integers(0, 5, 700)] + 0.4 * rng.normal(size=(700, 12))) * scale
    x[100:140] = x[100]  # ties
    rows = [(i, x[i].tolist(), int(rng.integers(0, 4)), 1, 1.0, 1) for i in range(700)]
    rows += [(750, None, 1, 1, 1.0, 1), (751, [0.0] * 12, 1, 1, 1.0, 1), (800, [0.0] * 12, 2, 1, 1.0, 1), (752, [float("nan")] * 12, 1, 1, 1.0, 1), (753, [None] * 12, 1, 1, 1.0, 1)]
    rows += [(754, x[3].tolist(), None, 1, 1.0, 1), (None, x[4].tolist(), 1, 1, 1.0, 1), (755, [1e300] * 12, 1, 1, 1.0, 1), (756, [1.0] * 5, 1, 1, 1.0, 1), (757, [], 1, 1, 1.0, 1)]
    rows += [rows[8], (9, x[10].tolist(), 0, 1, 1.0, 1), (850, [float("inf")] * 12, 1, 1, 1.0, 1)]
    want = sorted(plain_negatives(rows))
    assert len(want) > 100
    monkeypatch.setattr(negatives, "ROWS", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 6)
    df = spark.createDataFrame(rows, V)
    assert sorted(tuple(r) for r in negatives.mine(df, df["vec_id"] % 50 == 0).collect()) == want
    assert negatives.mine(df.limit(0), df["vec_id"] % 50 == 0).count() == 0
    assert negatives.mine(df.where("vec_id % 50 <> 0"), df["vec_id"] % 50 == 0).count() == 0


def test_score_bounds_hold_and_rule_rows_out():
    rng = np.random.default_rng(6)
    x = np.floor(256 * (np.repeat(rng.normal(size=(8, 16)), 60, 0) + 0.1 * rng.normal(size=(480, 16))))
    x[7], x[9] = 0, -x[8]
    directions = negatives.farthest_first(x, 8)
    norms, angles, out = np.sqrt((x * x).sum(1)), negatives.angles(x, directions), 0
    for i in range(0, 480, 7):
        low, high = negatives.score_bounds(norms[i], angles[i], norms, angles)
        scores = x @ x[i]
        assert (low <= scores).all() and (scores <= high).all()
        out += int((high < np.sort(scores)[-60]).sum())
    assert out > 0.3 * 480 * 69  # most rows of other clusters are never scored
