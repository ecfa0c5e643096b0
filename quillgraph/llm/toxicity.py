"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are hashed: each distinct lower-cased word of a text, and the first 5 letters of each longer one (insults are
inflected and compounded), present or not. One weight per feature is shared by all thresholds:
P(grade > k) = sigmoid(score - threshold_k), thresholds in ascending order. The expected severity is the sum of these
probabilities over k; it lies between 0 and the highest grade.

The model is fitted on a bounded sample of labelled rows (`Fit.sample_rows`, the lowest seeded hashes, half of them at most
from each end of the label). Features are screened by a chi-square test (`Fit.screen`); then proximal gradient steps with
an L1 penalty find the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIND_WORDS = regex.compile(r"\p{L}+").findall


@dataclass(frozen=True)
class Fit:
    sample_rows: int = 12_000
    bits: int = 18
    stem: int = 5
    grades: int = 3
    l1: float = 5e-4
    screen: float = 20.0
    steps: int = 400
    seed: int = 11


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of 2 ** bits features
    thresholds: np.ndarray  # ascending, one fewer than grades
    fit: Fit


class _FeatureMemo(dict):
    """Feature indexes of a word; emptied when it is full."""

    def __init__(self, fit: Fit):
        super().__init__()
        self.fit = fit

    def __missing__(self, word: str) -> tuple[int, ...]:
        low, mask = word.lower(), (1 << self.fit.bits) - 1
        out = [xxhash.xxh3_64_intdigest("w:" + low) & mask]
        if len(low) > self.fit.stem:
            out.append(xxhash.xxh3_64_intdigest("s:" + low[: self.fit.stem]) & mask)
        elif len(low) == self.fit.stem:
            out.append(xxhash.xxh3_64_intdigest("s:" + low) & mask)
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = tuple(out)
        return value


def features(text: str, memo: _FeatureMemo) -> np.ndarray:
    found: set[int] = set()
    for word in set(FIND_WORDS(text)):
        found.update(memo[word])
    return np.sort(np.fromiter(found, np.int64, len(found)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray, grades: int) -> np.ndarray:
    """Grades from yes/no labels: 0 if not toxic; toxic texts are dealt evenly into the grades 1, 2, ... by how many of
    their features are telling, which are those that toxic texts have at least ten times as often as others."""
    n_features = max((int(r[-1]) for r in rows if len(r)), default=0) + 1
    bad, good = np.zeros(n_features), np.zeros(n_features)
    for r, t in zip(rows, toxic, strict=True):
        (bad if t else good)[r] += 1
    telling = (bad + 0.1) / max(toxic.sum(), 1) > 10 * (good + 0.5) / max((~toxic).sum(), 1)
    telling &= bad >= 3
    counts = np.array([telling[r].sum() if len(r) else 0 for r in rows])
    out = np.zeros(len(rows), np.int64)
    if grades > 2 and toxic.any():
        cuts = np.quantile(counts[toxic], np.arange(1, grades - 1) / (grades - 1))
        out[toxic] = 1 + (counts[toxic, None] > cuts).sum(1)
    else:
        out[toxic] = 1
    return out


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, fit: Fit) -> Model:
    """Accelerated proximal gradient on the cumulative-link likelihood. Without rows, or with one grade only, all scores are 0."""
    dim, k = 1 << fit.bits, fit.grades - 1
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    # Only features that are clearly more or less frequent above grade 0 can carry weight; with the rest the model would
    # learn single texts by heart.
    has, up = np.bincount(flat, minlength=dim), np.bincount(flat, (grades > 0)[owner], dim)
    expected = has * (grades > 0).mean() if len(rows) else has
    often = (has >= 3) & ((up - expected) ** 2 > fit.screen * (expected + 1e-9) * (1 - expected / np.maximum(has, 1)))
    flat, owner = flat[often[flat]], owner[often[flat]]
    above = (grades[:, None] > np.arange(k)).astype(float)  # n x k
    # thresholds[j] = first + sum of exp(gaps) keeps them in order
    share = np.clip(above.mean(0), 1e-4, 1 - 1e-4) if len(rows) else np.full(k, 1e-4) * 0.5 ** np.arange(k)
    thresholds = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(k))
    weights = np.zeros(dim)
    if not len(rows) or len(set(grades.tolist())) < 2:
        return Model(weights, thresholds, fit)
    n = len(rows)
    # Rare grades count as much as common ones, up to a factor of four.
    frequency = np.bincount(grades, minlength=fit.grades) / n
    importance = np.minimum(4, 1 / np.maximum(frequency * fit.grades, 1e-9))[grades]
    importance /= importance.mean()
    look, last, momentum = weights.copy(), weights.copy(), 1.0
    rate = 4.0 / max(1.0, np.quantile(lengths, 0.5) ** 0.5)
    for _ in range(fit.steps):
        score = np.bincount(owner, look[flat], n)
        miss = (sigmoid(score[:, None] - thresholds) - above) * importance[:, None]
        slope = np.bincount(flat, miss.sum(1)[owner], dim) / n
        weights = look - rate * slope
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * fit.l1, 0)
        thresholds = np.maximum.accumulate(thresholds + rate * miss.mean(0))
        if (look - weights) @ (weights - last) > 0:  # overshot: start the momentum again
            momentum = 1.0
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        look = weights + (momentum - 1) / following * (weights - last)
        last, momentum = weights, following
    return Model(weights, thresholds, fit)


def training_rows(docs: DataFrame, labels: DataFrame, fit: Fit) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the sample. Labels that are null, or whose document is missing, are left out; of several labels of one document the highest holds."""
    order = F.xxhash64("doc_id", F.lit(fit.seed))
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    half = fit.sample_rows // 2
    sample = known.where("toxic").orderBy(order).limit(half).unionByName(known.where("NOT toxic").orderBy(order).limit(half))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def indexes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = _FeatureMemo(fit)
        for batch in batches:
            yield pa.array([features(t or "", memo) for t in batch.to_pylist()], pa.list_(pa.int64()))

    # The sample is bounded by fit.sample_rows, so it may be broadcast; it brings no text with it.
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        # of repeated ids with different texts the text with the smallest hash, so that reruns agree
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .select("doc_id", "toxic", indexes(F.col("text")).alias("features")).toArrow()
    ).sort_by("doc_id")
    return [np.asarray(x, np.int64) for x in rows["features"].to_pylist()], np.array(rows["toxic"].to_pylist(), bool)


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:  # noqa: B008
    """Model fitted on at most fit.sample_rows rows of labels (doc_id, toxic) that have a document in docs (doc_id, text).

    The labels only say yes or no; toxic texts are dealt into grades by how many telling features they have, features that the model sees too, so the severity
    above grade 1 says how many signs of toxicity a text has, not what a person thought of it. Null labels and ids are left out; null and empty texts have no
    features; of repeated ids one text counts, always the same. Without labels, or with labels of one kind, every text gets the same small severity. Other columns
    are not read.
    """
    rows, toxic = training_rows(docs, labels, fit)
    return fit_ordinal(rows, severity_grades(rows, toxic, fit.grades), fit)


def expected_severity(text: Column, model: Model) -> Column:
    """Expected severity (double, 0 to grades - 1) of a text. Null and empty texts have no features; they get the severity
    of a text without evidence. Texts are read whole; repetition of a word changes nothing."""
    fit, thresholds = model.fit, model.thresholds
    nonzero = np.flatnonzero(model.weights)
    weight_of = dict(zip(nonzero.tolist(), model.weights[nonzero].tolist(), strict=True))

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = _FeatureMemo(fit)
        # Nearly all words carry no weight: each word's features with weight are looked up once.
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            sums = []
            for text_ in batch.to_pylist():
                found: set[int] = set()
                for word in set(FIND_WORDS(text_ or "")):
                    own = known.get(word)
                    if own is None:
                        if len(known) > 400_000:
                            known.clear()
                        own = known[word] = tuple(i for i in memo[word] if i in weight_of)
                    if own:
                        found.update(own)
                sums.append(sum(weight_of[i] for i in sorted(found)))
            probabilities = sigmoid(np.array(sums)[:, None] - thresholds)
            yield pa.array(probabilities.sum(1), pa.float64())

    return score(text)


def grade(docs: DataFrame, model: Model, cut: float = 0.45) -> DataFrame:
    """doc_id, expected_severity, severity (nearest grade) and toxic (expected_severity >= cut) for each row of docs (doc_id, text).

    Repeated rows, and rows without an id, are graded each by itself; null and empty texts get the severity of a text without evidence; an empty table gives an
    empty result. Other columns are not read.
    """
    return docs.select("doc_id", expected_severity(F.col("text"), model).alias("expected_severity")).select(
        "doc_id",
        "expected_severity",
        F.floor(F.col("expected_severity") + 0.5).cast("long").alias("severity"),
        (F.col("expected_severity") >= cut).alias("toxic"),
    )
