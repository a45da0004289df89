"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashed words, neighbouring pairs and pairs with one word between. Each
coordinate has its own learning rate, and the L1 term leaves most weights at exactly 0, so that the model is a
short list of (feature, weight) that every task can hold. Features of fewer than MIN_DOCS training texts are left
out, or the learner would explain each text by words that no other text has.

Defined cases: a null text counts as empty; an empty text, or one without known features, gets the model's base
score; without usable labels every score is 0. Repeated labels of a document count once, the larger one. Other
columns, whatever their names, pass through untouched.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import fold, give_back, giving_back, joined, per_step, steps, table, text_of_word, words

BITS = 20
#: Training uses at most this many labelled documents, those with the smallest hashes of their ids.
SAMPLE = 16_384
MIN_DOCS = 6
THRESHOLD = 0.3

#: Words are runs of letters, digits, apostrophes and all bytes beyond ASCII.
SEPARATORS = np.ones(256, bool)
SEPARATORS[128:] = False
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = False


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    trained: bool


def features(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word, pair and skip pair of the texts; not distinct."""
    hashes, first, *_ = words(run, SEPARATORS)
    owner = text_of_word(hashes, first)
    texts, found = [owner], [hashes]
    for salt, ahead in ((0x51, 1), (0xA7, 2)):
        pairs = joined(hashes, (0, ahead))
        same = owner[: len(pairs)] == owner[ahead : ahead + len(pairs)]
        texts.append(owner[: len(pairs)][same])
        found.append(pairs[same] * np.uint64(2 * salt + 1))
    shift = np.uint64(64 - BITS)
    return np.concatenate(texts), (np.concatenate(found) >> shift).astype(np.int64)


class Learner:
    """One FTRL-proximal learner; the last coordinate is the bias, which has no L1 term."""

    def __init__(self, alpha=0.7, beta=1.0, l1=2.0, l2=1.0):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, rate = self.z[at], (self.beta + np.sqrt(self.n[at])) / self.alpha
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / (rate + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        sigma = (np.sqrt(n + error * error) - np.sqrt(n)) / self.alpha
        self.z[at] += error - sigma * w
        self.n[at] = n + error * error


def learn(sample: pd.DataFrame, epochs: int = 4) -> pd.DataFrame:
    """Train on the sample; the nonzero weights, the bias as feature -1."""
    sample = sample.sort_values("doc_id")
    examples, bias = [], 1 << BITS
    for run in steps((t or "").encode("utf-8", "replace") for t in sample["text"]):
        keys = np.unique(_keys(*features(run)))
        parts = np.split(keys & (bias - 1), np.searchsorted(keys >> BITS, np.arange(1, len(run))))
        examples += [p.astype(np.int32) for p in parts]
    seen = np.zeros(bias, np.int32)
    for p in examples:
        seen[p] += 1
    used = seen >= MIN_DOCS
    for i, p in enumerate(examples):  # one by one, so that they aren't held twice
        examples[i] = np.append(p[used[p]], np.int32(bias))
    learner, labels, order = Learner(), sample["toxic"].to_numpy() > 0, np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            learner.learn(examples[i], labels[i])
    weights = learner.weights(np.arange(bias + 1))
    at = np.flatnonzero(weights[:bias])
    return pd.DataFrame({"feature": np.append(at, -1), "weight": np.append(weights[at], weights[bias])})


def _keys(owner: np.ndarray, found: np.ndarray) -> np.ndarray:
    return owner << BITS | found


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample`` labelled documents outside the held-out fold."""
    known = (
        labels.select("doc_id", "toxic")
        .filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(fold("doc_id", 4) != 2)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("place", F.xxhash64("doc_id"))
        .orderBy("place", "doc_id")
        .limit(sample)
    )
    # At most ``sample`` rows of two numbers.
    found = documents.select("doc_id", "text").join(F.broadcast(known.select("doc_id", "toxic")), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _learned(sample: pd.DataFrame) -> pd.DataFrame:
    found = learn(sample)
    give_back()
    return found


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Train on a bounded sample, in one task; its weights are few, for the L1 term drops what is not needed."""
    rows = training_rows(documents, labels, sample)
    together = rows.withColumn("share", F.lit(0)).groupBy("share")
    learned = together.applyInPandas(_learned, "feature long, weight double").toPandas()
    if learned.empty:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0, False)
    words_only = learned[learned["feature"] >= 0]
    bias = float(learned["weight"][learned["feature"] == -1].iloc[0])
    return ToxicityModel(words_only["feature"].to_numpy(), words_only["weight"].to_numpy(), bias, True)


def score_texts(texts: pa.Array, model: ToxicityModel, dense: np.ndarray) -> np.ndarray:
    def score(run: list[bytes]) -> list[float]:
        owner, found = features(run)
        used = dense[found] != 0
        keys = np.unique(_keys(owner[used], found[used]))
        sums = np.bincount(keys >> BITS, weights=dense[keys & ((1 << BITS) - 1)], minlength=len(run))
        return list(1 / (1 + np.exp(-np.clip(sums + model.bias, -35, 35))))

    if not model.trained:
        return np.zeros(len(texts))
    return np.array(per_step(score, texts), np.float64)


def with_toxicity(documents: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add (or replace) the column ``out``: the toxicity of the whole text, from 0 to 1."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from giving_back(each(batches))

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(1 << BITS)
        dense[model.features] = model.weights
        for texts in batches:
            yield pa.array(score_texts(texts, model, dense), pa.float64())

    return documents.withColumn(out, scored(F.col(text)))


def op2_toxicity(spark, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = train(documents, table(spark, d, "labels"))
    scored = with_toxicity(documents.select("doc_id", "text"), model, out="score")
    return scored.select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
