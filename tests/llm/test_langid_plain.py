"""The language classifier against plain loops: n-grams, TF-IDF, the learner, the temperature, and a whole fit."""

import hashlib
import math
import random
from collections import Counter

import numpy as np

from evidentia.llm import langid

ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.01


def plain_counts(text):
    """Buckets of the n-grams of a text, by slices of it."""
    if not any(c.isalpha() for c in text or ""):
        return None
    clean = " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or clean[-1] != " ":
            clean += c
    found = Counter()
    for n in langid.SIZES:
        for i in range(1 if n == 1 else 0, len(clean) - n + 1):
            h = n
            for c in clean[i : i + n]:
                h = (h * 0x01000193 + ord(c) * 0x9E3779B1) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x85EBCA77) & 0xFFFFFFFF
            found[h >> (32 - langid.BITS)] += 1
    return found


def plain_features(counts, idf):
    x = {f: (1 + math.log(c)) * idf[f] for f, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {f: v / norm for f, v in x.items()}


class PlainFtrl:
    def __init__(self, classes):
        self.z, self.n, self.classes = {}, {}, classes

    def weight(self, f, c):
        z, n = self.z.get((f, c), 0.0), self.n.get((f, c), 0.0)
        return 0.0 if abs(z) <= L1 else -(z - math.copysign(L1, z)) / ((BETA + math.sqrt(n)) / ALPHA + L2)

    def logits(self, x):
        return [sum(v * self.weight(f, c) for f, v in x.items()) for c in range(self.classes)]

    def learn(self, x, y):
        e = [math.exp(v) for v in self.logits(x)]
        old = {(f, c): self.weight(f, c) for f in x for c in range(self.classes)}
        for c in range(self.classes):
            p = e[c] / sum(e) - (c == y)
            for f, v in x.items():
                g, n = v * p, self.n.get((f, c), 0.0)
                step = (math.sqrt(n + g * g) - math.sqrt(n)) / ALPHA
                self.z[f, c] = self.z.get((f, c), 0.0) + g - step * old[f, c]
                self.n[f, c] = n + g * g


def plain_temperature(logits, y):
    best = (math.inf, 1.0)
    for i in range(81):
        t, loss = math.exp(-1 + 4 * i / 80), 0.0
        for row, k in zip(logits, y):
            e = [math.exp((v - max(row)) / t) for v in row]
            loss -= math.log(max(e[k] / sum(e), 1e-12)) / len(y)
        best = min(best, (loss, t))
    return best[1]


def some_texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = {"xa": ["ba", "bo", "ti", "É"], "xb": ["ga", "bo", "ki"], "xc": ["ла", "мо", "ba"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(alphabet))
        rows.append((i, " ".join("".join(rng.choices(alphabet[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 12))) + rng.choice(["", " 12!", "..Q"]), lang))
    return rows


def test_ngrams_and_features(monkeypatch):
    idf = np.random.default_rng(1).random(1 << langid.BITS) + 0.5
    for piece in (1 << 18, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        for _, text, _ in some_texts(40) + [(0, "  a1b  C", ""), (0, "ß", ""), (0, "x" * 50, "")]:
            counts, want = langid.gram_counts(text), plain_counts(text)
            assert {f: int(counts[f]) for f in np.flatnonzero(counts)} == dict(want)
            at, x = langid.features(counts, idf)
            plain = plain_features(want, idf)
            assert set(at.tolist()) == set(plain) and np.allclose(x, [plain[f] for f in at.tolist()], rtol=1e-12)
    assert langid.gram_counts("12 !") is None and langid.gram_counts(None) is None and langid.gram_counts("") is None


def test_the_learner_and_the_temperature():
    rng = random.Random(4)
    fast, plain = langid.Ftrl(3), PlainFtrl(3)
    for _ in range(120):
        x = {f: rng.random() for f in rng.sample(range(30), rng.randint(1, 6))}
        y = rng.randrange(3)
        fast.learn(np.array(list(x)), np.array(list(x.values())), y)
        plain.learn(x, y)
    w = fast.weights(slice(None))
    assert all(abs(w[f, c] - plain.weight(f, c)) < 1e-9 for f in range(30) for c in range(3)) and (w[30:] == 0).all()
    assert any(plain.weight(f, c) == 0.0 for f in range(30) for c in range(3)) or np.count_nonzero(w[:30]) == 90
    logits = np.random.default_rng(2).normal(size=(50, 3)) * 4
    y = [int(r.argmax()) if i % 3 else int(r.argmin()) for i, r in enumerate(logits)]
    assert abs(langid.temperature(logits, np.array(y)) - plain_temperature(logits.tolist(), y)) < 1e-12 and langid.temperature(logits[:0], np.array([], int)) == 1.0


def test_a_fit_equals_a_plain_loop(spark):
    rows = some_texts(90) + [(500, "12", "xa"), (501, None, "xb")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = [plain_counts(t) for _, t, _ in rows]
    held = [c for c in counts if c is not None]
    df = Counter(f for c in held for f in c)
    idf = {f: math.log((1 + len(held)) / (1 + df.get(f, 0))) + 1 for f in range(1 << langid.BITS)}
    assert model.languages == ("xa", "xb", "xc") and all(abs(model.idf[f] - idf[f]) < 1e-12 for f in df)
    order = sorted((hashlib.md5((t or "").encode()).hexdigest(), lang, i) for i, (_, t, lang) in enumerate(rows) if counts[i] is not None)
    data = []
    for _, lang, i in order:
        x = {f: float(np.float32(v)) for f, v in plain_features(counts[i], idf).items()}
        data.append((x | {1 << langid.BITS: 1.0}, model.languages.index(lang)))
    learner = PlainFtrl(3)
    for _ in range(3):
        for i, (x, y) in enumerate(data):
            if i % 5:
                learner.learn(x, y)
    for f in list(df) + [1 << langid.BITS]:
        assert all(abs(model.weights[f, c] - learner.weight(f, c)) < 1e-5 for c in range(3))
    t = plain_temperature([learner.logits(x) for x, _ in data[::5]], [y for _, y in data[::5]])
    assert abs(model.scale - t) < 1e-9
    told = model.predict("ga ki boga")
    assert told[0] == "xb" and 0 <= told[1] <= 1
