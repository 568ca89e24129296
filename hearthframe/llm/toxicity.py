"""Toxicity from two interpolated Kneser-Ney bigram models that share their lowest order.

Both classes back off from bigrams to class continuation counts and from there to one distribution of continuation
counts over both classes, so an expression too rare to tell the classes apart contributes about the same to either.
What discounting takes goes to the lower order whole, so each class's probabilities sum to one over all words and the
unknown one. The score is a logistic function of the length-normalised difference of the two log-likelihoods, calibrated on
the natural mix of the classes.

Labels are learned from a bounded sample: of each class at most `sample` rows and `characters` of text, in hash order, near
copies among them left out. Counts, probabilities and their ratios are Spark tables with every n-gram of the sample, single
ones included; of them the driver gets a 64-bit hash and a float for each n-gram, which is bounded by `characters`. Scoring
reads whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .base import clear, fold, pieces, send
from .minmax import signatures
from .shingles import Hasher, mix

WORD = re.compile(r"\w+")
START = 0
SKETCHES = 4
#: Words remembered with their hash in a task.
MEMO = 1 << 16


class Hashes(dict):
    """Hash of each word, never that of the start."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = found = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) or 1) - (1 << 63)
        return found


def pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(history.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + word.view(np.uint64)).view(np.int64)


def bigrams(text: str, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Histories and words of the whole text in order; the history of the first word is START."""
    own = [np.array([hashes[w] for w in WORD.findall(piece.lower())], np.int64) for piece in pieces(text)]
    words = np.concatenate(own)
    return np.concatenate(([START], words[:-1])).astype(np.int64) if len(words) else words, words


@dataclass
class ToxicityModel:
    """Log ratios, toxic over ordinary, of one fitted model; tables are sorted by hash."""

    words: np.ndarray
    lower: np.ndarray      # of each word's backed-off probability
    back: np.ndarray       # of the weight that each word as history leaves to the lower order
    unknown: float         # of an unknown word
    keys: np.ndarray
    direct: np.ndarray     # of each bigram's probability
    weights: np.ndarray    # of the calibrating logistic function over features()

    def find(self, table: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.full(len(wanted), other), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        hit = table[at] == wanted
        return np.where(hit, values[at], other).astype(float), hit

    def ratios(self, history: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct bigram: by the lower order alone, and interpolated. A repeated bigram counts once."""
        key, first = np.unique(pair_keys(history, word), return_index=True)
        lower = self.find(self.words, self.lower, word[first], self.unknown)[0]
        backed = lower + self.find(self.words, self.back, history[first], 0.0)[0]
        direct, hit = self.find(self.keys, self.direct, key, 0.0)
        return lower, np.where(hit, direct, backed)

    def features(self, history: np.ndarray, word: np.ndarray) -> tuple[float, ...]:
        """1, then of both orders the mean ratio, and the evidence beyond one nat over the length and over its root."""
        out = [1.0]
        for found in self.ratios(history, word):
            n, strong = max(len(found), 1), float(np.maximum(found - 1, 0).sum())
            out += [float(found.sum()) / n, strong / n, strong / n ** 0.5]
        return tuple(out)

    def score(self, history: np.ndarray, word: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, self.features(history, word)), -40, 40))))


def bigram_counts(batches):
    """(key, history, word, ordinary count, toxic count) of a few hundred rows at a time."""
    hashes = Hashes()
    for pdf in batches:
        for start in range(0, len(pdf), 256):
            part = pdf.iloc[start:start + 256]
            for c in (0, 1):
                found = [bigrams(clear(t), hashes) for t in part.loc[part["toxic"] == c, "text"]]
                if not found:
                    continue
                history, word = (np.concatenate(x) for x in zip(*found))
                key, first, n = np.unique(pair_keys(history, word), return_index=True, return_counts=True)
                zero = np.zeros(len(n), np.int64)
                yield pd.DataFrame({"key": key, "h": history[first], "w": word[first], "n0": zero if c else n, "n1": n if c else zero})


def sketched(batches):
    """Rows with smallest images of their three-word shingles under some permutations; zeros without words."""
    hasher = Hasher()
    for pdf in batches:
        sets = [hasher.shingles(clear(t), 3) for t in pdf["text"]]
        full = [k for k, s in enumerate(sets) if len(s)]
        marks = np.zeros((len(sets), SKETCHES), np.int64)
        if full:
            marks[full] = signatures([sets[k] for k in full], SKETCHES, 1).view(np.int64)
        yield pdf.assign(sketch=list(marks))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton steps for a small ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


def neutral() -> ToxicityModel:
    """Without two classes to learn from, every text scores 0."""
    none = np.zeros(0, np.int64)
    return ToxicityModel(none, none, none, 0.0, none, none, np.array([-40.0, 0, 0, 0, 0, 0, 0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int, held: int, sample: int, characters: int) -> DataFrame:
    """(doc_id, text, toxic, calibrate): rows outside fold `held` within the bounds, without near copies inside a class.

    Repeated labels of a document count once (the larger wins).
    """
    known = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .where(fold(folds) != held))
    order = F.xxhash64("doc_id", F.lit(7))
    sizes = docs.where("text IS NOT NULL").groupBy("doc_id").agg(F.sum(F.length("text")).alias("size"))
    known = known.join(sizes, "doc_id")
    chosen = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample) for c in (0, 1)]
    # At most `sample` rows of a class are left to be ordered.
    upto = Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    picked = (chosen[0].unionByName(chosen[1]).withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).where(F.col("before") < characters)
              .select("doc_id", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0).alias("calibrate")))
    # At most 2 * sample ids, so the broadcast has a fixed bound.
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialise(rows.select("doc_id", "text", "toxic", "calibrate").mapInPandas(
        sketched, f"doc_id {kind}, text string, toxic int, calibrate boolean, sketch array<long>").withColumn("row", F.xxhash64("doc_id", "text")), "toxic-sample")
    # Copies of one text would pass for evidence: a row goes if any of its sketches has an earlier row of its class.
    marks = rows.select("row", "doc_id", "toxic", "sketch")
    for k in range(SKETCHES):
        same = Window.partitionBy("toxic", F.get("sketch", k))
        marks = marks.withColumn(f"first{k}", F.min("doc_id").over(same) == F.col("doc_id"))
    kept = marks.where(" AND ".join(f"first{k}" for k in range(SKETCHES))).select("row").distinct()
    return materialise(rows.join(kept, "row").select("doc_id", "text", "toxic", "calibrate"), "toxic-rows")


@dataclass
class Probabilities:
    """Tables of the two models under each discount d: columns end in the class and the number of the discount."""
    words: DataFrame       # w, lower<c>_<k>
    histories: DataFrame   # h, c<c>, back<c>_<k>
    counted: DataFrame
    unknown: dict          # (c, k) to the lower order's probability of the unknown word
    discounts: tuple


def kneser_ney(counted: DataFrame, discounts: tuple) -> Probabilities | None:
    """Interpolated probabilities of all counted bigrams (key, h, w, n0, n1); None unless both classes have some.

    Bigrams are discounted by d. From a continuation count, d + d * root(the count expected by the shared counts) is
    taken, so that counts too small to tell the classes apart go to the shared backoff. What is taken from a count,
    at most the count itself, is the lower order's weight.
    """
    both = [(c, k) for c in (0, 1) for k in range(len(discounts))]
    words = materialise(counted.groupBy("w").agg(*(F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in (0, 1)), F.count("*").alias("shared")), "toxic-words")
    facts = words.agg(F.count("*").alias("types"), F.sum("shared").alias("shared"), *(F.sum(f"k{c}").alias(f"k{c}") for c in (0, 1))).first()
    if not facts["k0"] or not facts["k1"]:
        return None

    def taken(c: int, k: int) -> Column:
        d = discounts[k]
        return F.least(F.col(f"k{c}").cast("double"), d + d * F.sqrt(F.col("shared") * (facts[f"k{c}"] / facts["shared"])))
    held = words.agg(*(F.sum(taken(c, k)).alias(f"t{c}_{k}") for c, k in both)).first()
    base = facts["shared"] + 0.5 * (facts["types"] + 1)
    shared = (F.col("shared") + 0.5) / base
    unknown = {(c, k): held[f"t{c}_{k}"] * 0.5 / base / facts[f"k{c}"] for c, k in both}
    lower = words.select("w", *(((F.col(f"k{c}") - taken(c, k) + held[f"t{c}_{k}"] * shared) / facts[f"k{c}"]).alias(f"lower{c}_{k}") for c, k in both))

    def cut(c: int, k: int) -> Column:
        return F.least(F.col(f"n{c}").cast("double"), F.lit(float(discounts[k])))
    sums = counted.groupBy("h").agg(*(F.sum(f"n{c}").alias(f"c{c}") for c in (0, 1)), *(F.sum(cut(c, k)).alias(f"m{c}_{k}") for c, k in both))
    histories = materialise(sums.select("h", "c0", "c1", *(F.when(F.col(f"c{c}") > 0, F.col(f"m{c}_{k}") / F.col(f"c{c}")).otherwise(1.0).alias(f"back{c}_{k}")
                                                           for c, k in both)), "toxic-histories")
    return Probabilities(lower, histories, counted, unknown, discounts)


def collected(df: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first column, hashes, in order, and the others along with it, without a Python object for each row."""
    got = df.toArrow()
    hashes = got.column(0).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], [got.column(i).to_numpy()[order] for i in range(1, got.num_columns)]


def word_models(found: Probabilities) -> list[ToxicityModel]:
    """The lower order alone under each discount."""
    def ratio(k: int) -> Column:
        return F.log(F.col(f"lower1_{k}") / F.col(f"lower0_{k}")).cast("float").alias(f"r{k}")
    words, lower = collected(found.words.select("w", *(ratio(k) for k in range(len(found.discounts)))))
    none = np.zeros(0, np.int64)
    return [ToxicityModel(words, values, np.zeros(len(words), np.float32), float(np.log(found.unknown[1, k] / found.unknown[0, k])), none,
                          none, np.array([0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0])) for k, values in enumerate(lower)]


def with_bigrams(model: ToxicityModel, found: Probabilities, k: int) -> ToxicityModel:
    """The interpolated model. Words and histories of the sample are few beside its bigrams and go to the tasks that hold those."""
    words, lower = collected(found.words.select("w", f"lower0_{k}", f"lower1_{k}"))
    histories, facts = collected(found.histories.select("h", "c0", "c1", f"back0_{k}", f"back1_{k}"))
    sent, d = found.words.sparkSession.sparkContext.broadcast((words, lower, histories, facts)), found.discounts[k]

    def ratio(batches):
        words, lower, histories, (c0, c1, back0, back1) = sent.value
        for batch in batches:
            h, w, n0, n1 = (batch.column(i).to_numpy() for i in range(1, 5))
            at, from_ = np.searchsorted(words, w), np.searchsorted(histories, h)
            p = [np.maximum(n - d, 0) / np.maximum(c[from_], 1) + back[from_] * low[at] for n, c, back, low in zip((n0, n1), (c0, c1), (back0, back1), lower)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.log(p[1] / p[0]).astype(np.float32))], ["hash", "r"])
    keys, (direct,) = collected(found.counted.select("key", "h", "w", "n0", "n1").mapInArrow(ratio, "hash long, r float"))
    sent.destroy()
    # A history is a word of the texts or the start, which is no word.
    every = np.union1d(words, histories)
    lowers, backs = np.full(len(every), model.unknown, np.float32), np.zeros(len(every), np.float32)
    lowers[np.searchsorted(every, words)] = model.lower
    backs[np.searchsorted(every, histories)] = np.log(facts[3] / facts[2])
    return ToxicityModel(every, lowers, backs, model.unknown, keys, direct, np.array([0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0]))


def measured(rows: DataFrame, models: list[ToxicityModel]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels of the rows and, for each model, their features."""
    # One broadcast: the models share their hashes.
    sent = rows.sparkSession.sparkContext.broadcast([vars(model) for model in models])

    def measure(batches):
        own, hashes = [ToxicityModel(**data) for data in sent.value], Hashes()
        for pdf in batches:
            texts = [bigrams(clear(t), hashes) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"].astype(float)} | {
                f"f{k}": [list(model.features(*t)) for t in texts] for k, model in enumerate(own)})
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic double, " + ", ".join(f"f{k} array<double>" for k in range(len(models)))
    got = rows.select("doc_id", "text", "toxic").mapInPandas(measure, schema).toPandas().sort_values("doc_id", kind="stable")
    sent.destroy()
    return got["toxic"].to_numpy(), [np.array(got[f"f{k}"].tolist()) for k in range(len(models))]


def log_loss(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ weights, -40, 40))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = 10_000, characters: int = 40_000_000,
        discounts: tuple = (0.5, 1.0, 2.0)) -> ToxicityModel:
    """Learn from labelled rows outside fold `held`.

    A quarter of the sampled rows is kept back. With the lower order alone it picks the discount by log loss; with the
    interpolated model under that discount, whose bigrams alone leave their tables, it calibrates the score.
    """
    rows = labelled_sample(docs, labels, folds, held, sample, characters)
    counted = materialise(rows.where("NOT calibrate").select("text", "toxic").mapInPandas(bigram_counts, "key long, h long, w long, n0 long, n1 long")
                          .groupBy("key", "h", "w").agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1")), "toxic-bigrams")
    found = kneser_ney(counted, discounts)
    if found is None:
        return neutral()
    models, back = word_models(found), rows.where("calibrate")
    y, features = measured(back, models)
    if len(set(y.tolist())) < 2:
        return with_bigrams(models[0], found, 0)
    losses = [log_loss(x[:, :4], y, logistic(x[:, :4], y)) for x in features]
    k = int(np.argmin(losses))
    model = with_bigrams(models[k], found, k)
    y, (x,) = measured(back, [model])
    model.weights = logistic(x, y)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 from 0.5 on). Null and empty texts get the calibrated prior of a text without words."""
    sent = send(docs.sparkSession, model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own, hashes = sent(), Hashes()
        return pd.Series([own.score(*bigrams(clear(t), hashes)) for t in texts], dtype="float64")

    return docs.withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; repeated rows are scored each, other columns are not read."""
    model = fit(docs, labels, folds, held, **fitting)
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(folds) == held).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """Rows of `docs` that are not predicted toxic, with all their columns."""
    model = fit(docs, labels, **fitting)
    names = docs.columns
    scored = score_toxicity(docs.select("text", F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row")), model)
    return scored.where("predicted = 0").select("_row.*")
