"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed character 1- to 4-grams; a linear softmax maps
the mean to languages. Both matrices are trained by stochastic gradient descent in numpy on a
bounded sample: of every language at most `per_language` rows, fewer where there are so many languages that
`rows` would be exceeded, at least one, in hash order. A part kept back fits a temperature and the rejection threshold. As the model is linear,
scoring needs only the table of logits of each bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import clear, fold, pieces, send

BITS = 15
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def lettered(text: str) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return any(map(str.isalpha, text))


def buckets(text: str) -> np.ndarray:
    """Hash buckets of the character 1- to 4-grams of the lower-cased text."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, rolled = [], np.zeros(len(code), np.uint32)
    for n in range(min(4, len(code))):
        rolled = (rolled[:len(code) - n] if n else rolled) * np.uint32(31) + code[n:] * MIX[n]
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
        out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out)


def bag(text: str) -> tuple[np.ndarray, int]:
    """Counts of buckets over the whole text, and their sum."""
    total = np.zeros(1 << BITS, np.int64)
    for piece in pieces(text):
        total += np.bincount(buckets(piece), minlength=1 << BITS)
    return total, int(total.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list
    logits: np.ndarray        # [buckets, languages]
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, text) -> tuple[str, float]:
        """`und` with score 0 for null or letterless texts, or when nothing was learned."""
        text = clear(text)
        if not self.languages or not lettered(text):
            return "und", 0.0
        total, count = np.zeros(len(self.languages)), 0
        for piece in pieces(text):
            at = buckets(piece)
            total += self.logits[at].sum(axis=0)
            count += len(at)
        p = softmax((total / count + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(bags: list, y: np.ndarray, languages: int, dim: int = 16, epochs: int = 6, step: float = 0.5, seed: int = 5):
    """Embeddings and output weights by stochastic gradient descent over single documents."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim))
    w, b = np.zeros((dim, languages)), np.zeros(languages)
    for epoch in range(epochs):
        rate = step * (1 - epoch / epochs)
        for i in rng.permutation(len(bags)):
            at, share = bags[i]
            h = share @ e[at]
            g = softmax(h @ w + b)
            g[y[i]] -= 1
            back = w @ g
            w -= rate * np.outer(h, g)
            b -= rate * g
            e[at] -= rate * 20 * share[:, None] * back
    return e, w, b


def fit(docs: DataFrame, folds: int = 3, held: int = 1, per_language: int = 600, rows: int = 38_400,
        precision: float = 0.99) -> LanguageModel:
    """Learn from text and non-null lang outside fold `held`; only the sample's bags reach the driver."""
    known = docs.select("doc_id", "text", "lang").where((fold(folds) != held) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    quota = min(per_language, max(1, rows // max(1, known.select("lang").distinct().count())))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
    ids = known.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota).select("doc_id").distinct()
    # At most `rows` ids, or one of each language.
    sample = known.join(F.broadcast(ids), "doc_id").select("text", "lang", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).alias("part"))

    def bagged(batches):
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                counts, n = bag(text)
                at = np.flatnonzero(counts)
                rows.append((at.astype(np.int32).tobytes(), (counts[at] / n).astype(np.float32).tobytes()))
            yield pd.DataFrame({"at": [r[0] for r in rows], "share": [r[1] for r in rows], "lang": pdf["lang"], "part": pdf["part"]})

    got = sample.mapInPandas(bagged, "at binary, share binary, lang string, part long").toPandas()
    languages = sorted(got["lang"].unique())
    if not languages:
        return LanguageModel([], np.zeros((1, 0)), np.zeros(0), 1.0, 1.0)
    got = got.sort_values(["lang", "at", "share"]).reset_index(drop=True)
    y = got["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    bags = [(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32).astype(float)) for a, s in zip(got["at"], got["share"])]
    back = got["part"].to_numpy() == 0
    fitted = np.flatnonzero(~back) if (~back).any() else np.arange(len(bags))
    e, w, b = train([bags[i] for i in fitted], y[fitted], len(languages))
    logits, temperature, reject = e @ w, 1.0, 0.0
    if back.any():
        z, t = np.array([bags[i][1] @ logits[bags[i][0]] + b for i in np.flatnonzero(back)]), y[back]
        grid = np.geomspace(0.05, 5, 40)
        temperature = float(min(grid, key=lambda k: -np.log(softmax(z / k)[np.arange(len(t)), t] + 1e-12).mean()))
        p = softmax(z / temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == t
        down = np.argsort(-score)
        share = np.cumsum(right[down]) / np.arange(1, len(t) + 1)
        enough = np.flatnonzero(share >= precision)
        reject = float(score[down][enough[-1]]) if len(enough) else 1.0
    return LanguageModel(languages, logits.astype(np.float32), b, temperature, reject)


def identify_language(docs: DataFrame, folds: int = 3, held: int = 1, **fitting) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row; `lang` is only read of training rows.

    Repeated rows are predicted each; equal logits give the language that sorts first. `accepted` is false below the calibrated rejection threshold and for `und`.
    """
    model = fit(docs, folds, held, **fitting)
    sent = send(docs.sparkSession, model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = sent()
        found = [own.predict(t) for t in texts]
        return pd.DataFrame({"lang": [f[0] for f in found], "score": [f[1] for f in found]})

    return (docs.select("doc_id", predict("text").alias("_p"))
            .select("doc_id", (fold(folds) == held).alias("held_out"), F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"),
                    ((F.col("_p.lang") != "und") & (F.col("_p.score") >= model.reject_below)).alias("accepted")))
