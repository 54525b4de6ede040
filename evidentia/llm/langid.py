"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back

#: Hashed features, n-gram sizes, characters of a text that are in memory at a time.
BITS, SIZES, PIECE = 15, (1, 2, 3), 1 << 18
#: The bound of the sample that fits the classifier, over all languages; document frequencies come from all training rows.
MOST_SAMPLE = 4000
MOST_LANGUAGES = 1000
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000))
    return _letters[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, None without letters. Letters are lower-cased; what lies between
    is one space; a piece is read at a time, n-grams across its edge included."""
    counts, held, any_letter = np.zeros(1 << BITS, np.int64), np.array([32], np.uint32), False
    for at in range(0, len(text or ""), PIECE):
        code = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[code]
        any_letter = any_letter or bool(letter.any())
        code = np.where(letter, code, 32).astype(np.uint32)
        code = np.concatenate([held, code])
        keep = (code != 32) | (np.concatenate([[0], code[:-1]]) != 32)
        keep[: len(held)] = True
        code = code[keep]
        for n in SIZES:
            first = max(0, len(held) - n + 1)
            if len(code) - n + 1 > first:
                h = np.full(len(code) - n + 1 - first, n, np.uint32)
                for i in range(n):
                    h = h * np.uint32(0x01000193) + code[first + i : len(code) - n + 1 + i] * np.uint32(0x9E3779B1)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
                counts += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
        held = code[-(max(SIZES) - 1) :]
    return counts if any_letter else None


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length sublinear TF-IDF."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


class Ftrl:
    """Follow the regularised leader, proximal, with elastic net, for one weight a feature and class."""

    def __init__(self, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01):
        self.z, self.n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = np.outer(x, p)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """What to divide logits by for the least log loss on held-back rows."""
    if not len(y):
        return 1.0
    tries = np.exp(np.linspace(-1, 3, 81))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in tries]
    return float(tries[int(np.argmin(loss))])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    scale: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        at, x = features(counts, self.idf)
        p = softmax((x @ self.weights[at] + self.weights[-1]) / self.scale)
        best = int(np.argmax(p))  # ties: the first by name
        return self.languages[best], float(p[best])


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, epochs: int = 3, **penalties) -> Model:
    """Learn from the rows with a language. Document frequencies are counted over all of them; weights and temperature
    come from at most MOST_SAMPLE rows, as many for each language, chosen by the hash `key` of a row."""
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")) if key is None else key
    rows = rows.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), key.alias("key"))
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = tuple(sorted(known))
    if not languages:
        return Model((), np.zeros(0), np.zeros(0), 1.0)

    def frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                if (counts := gram_counts(text)) is not None:
                    df += counts > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"feature": np.append(at, -1), "n": np.append(df[at], n)})
        give_back()

    found = rows.select("text").mapInPandas(frequency, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros((1 << BITS) + 1, np.int64)  # one place a feature, the last for the count of texts
    df[found["feature"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    each = max(1, MOST_SAMPLE // len(languages))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, 1.5 * each / known[lang]))])
    draw = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    sample = rows.where(draw <= F.element_at(share, F.col("lang"))).withColumn("nth", nth).where(F.col("nth") <= each)

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(lang, key, *features(c, idf)) for text, lang, key in zip(batch["text"], batch["lang"], batch["key"]) if (c := gram_counts(text)) is not None]
            yield pd.DataFrame({"lang": [g[0] for g in got], "key": [g[1] for g in got], "at": [g[2].astype(np.int32) for g in got], "x": [g[3].astype(np.float32) for g in got]})

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "lang"])
        model, last = Ftrl(len(languages), **penalties), 1 << BITS
        rows = [(np.append(a, last), np.append(x.astype(np.float64), 1.0), languages.index(lang)) for a, x, lang in zip(group["at"], group["x"], group["lang"])]
        held = rows[::5] if len(rows) >= 50 else []
        used = [r for i, r in enumerate(rows) if i % 5] if held else rows
        for _ in range(epochs):
            for r in used:
                model.learn(*r)
        w = model.weights(slice(None))
        logits = np.array([x @ w[a] for a, x, _ in held]).reshape(-1, len(languages))
        some = np.argwhere(w != 0)
        out = pd.DataFrame({"feature": some[:, 0], "language": some[:, 1], "value": w[some[:, 0], some[:, 1]]})
        t = temperature(logits, np.array([y for *_, y in held], np.int64))
        return pd.concat([out, pd.DataFrame({"feature": [-1], "language": [0], "value": [t]})])

    learnt = (
        sample.select("text", "lang", "key").mapInPandas(compute, "lang string, key string, at array<int>, x array<float>").withColumn("all", F.lit(0))
        .groupBy("all").applyInPandas(train, "feature long, language long, value double").toPandas()
    )
    weights, scale = np.zeros(((1 << BITS) + 1, len(languages))), 1.0
    if len(learnt):
        scale = float(learnt.loc[learnt["feature"] < 0, "value"].iloc[0])
        learnt = learnt[learnt["feature"] >= 0]
        weights[learnt["feature"], learnt["language"]] = learnt["value"]
    return Model(languages, idf, weights, scale)


def predict(docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "told") -> DataFrame:
    """docs with struct<lang_pred, score> as_col, from the whole text alone. Without letters (or null): und, 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # features x languages, a fixed size

    @F.arrow_udf("struct<lang_pred: string, score: double>")  # a text at a time leaves the Arrow batch
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for texts in batches:
            told = [model.predict(t.as_py()) for t in texts]
            lang, score = pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64())
            yield pa.StructArray.from_arrays([lang, score], ["lang_pred", "score"])
        give_back()

    # else a filter on what it says and a column of it would run it twice
    return docs.withColumn(as_col, run.asNondeterministic()(F.col(text_col)))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows whose fold isn't 0 and predict every row: id_col, held_out (fold 0), lang_pred, score.
    No labels at all, or an empty table: every prediction is und with score 0."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    model = fit(docs.where(fold(id_col) != 0), text_col, lang_col, key)
    told = predict(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return told.select(F.col("id").alias(id_col), (fold("id") == 0).alias("held_out"), "told.lang_pred", "told.score")
