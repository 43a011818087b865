"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is ``w0 + sum(w_i x_i)`` plus all pairwise interactions ``<v_i, v_j> x_i x_j``,
the latter by the identity ``sum over factors of ((sum v x)^2 - sum (v x)^2) / 2``, in time linear in
the number of words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import importable

BUCKETS = 1 << 14
STATISTICS = (
    "log_words", "mean_length", "distinct", "repeated", "symbols", "pipes", "shouts", "capitals", "digits", "stops", "lines", "not_ascii", "log_chars"
)


def held_out(id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(False))


def describe(text: str, n_chars: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and weights of the words, and the statistics of a text."""
    words = text.split()
    n = len(words)
    counts = Counter(words)
    index = np.fromiter((zlib.crc32(w.encode("utf-8")) % BUCKETS for w in counts), dtype=np.int32, count=len(counts))
    weight = 1 + np.log(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    if len(weight):
        weight /= np.sqrt((weight * weight).sum())
    raw = np.bincount(np.frombuffer(text.encode("utf-8"), dtype=np.uint8), minlength=256)
    share = lambda letters: sum(int(raw[ord(c)]) for c in letters) / max(n, 1)
    size = max(int(raw.sum()), 1)
    same = sum(map(str.__eq__, words, words[1:]))
    statistics = np.array([
        np.log1p(n), sum(map(len, words)) / max(n, 1), len(counts) / max(n, 1), same / max(n, 1), share("#*$%&<>"), share("|"), share("!"),
        raw[65:91].sum() / size, raw[48:58].sum() / size, share(".,;:?"), share("\n"), raw[128:].sum() / size, np.log1p(max(n_chars, 0)),
    ])
    return index, weight, statistics


@dataclass
class Machine:
    """Weights of the fitted model; scoring is vectorised over many texts."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, described: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers, values and row starts; the statistics follow the word buckets."""
        k = len(STATISTICS)
        own = BUCKETS + np.arange(k, dtype=np.int32)
        index = np.concatenate([np.concatenate((d[0], own)) for d in described])
        value = np.concatenate([np.concatenate((d[1], np.clip((d[2] - self.mean) / self.scale, -4, 4) / np.sqrt(k))) for d in described])
        sizes = np.array([len(d[0]) + k for d in described])
        return index, value, np.concatenate(([0], np.cumsum(sizes)[:-1]))

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and the factor sums they came from."""
        each = self.factors[index] * value[:, None]
        sums = np.add.reduceat(each, starts, axis=0)
        pairs = 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((each * each).sum(axis=1), starts))
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + pairs, sums

    def scores(self, described: list) -> np.ndarray:
        if not described:
            return np.zeros(0)
        margins, _ = self.margins(*self.inputs(described))
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def fit(described: list, labels: np.ndarray, factors: int = 8, epochs: int = 30, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad over shuffled batches of a bounded sample. Without rows every score is 0.5."""
    rng, n_inputs = np.random.default_rng(seed), BUCKETS + len(STATISTICS)
    table = np.array([d[2] for d in described]) if described else np.zeros((1, len(STATISTICS)))
    machine = Machine(0.0, np.zeros(n_inputs), rng.normal(0, 0.05, (n_inputs, factors)), table.mean(axis=0), table.std(axis=0) + 1e-3)
    if not described:
        machine.factors[:] = 0
        return machine
    share = np.clip(labels.mean(), 0.5 / len(labels), 1 - 0.5 / len(labels))
    machine.bias = float(np.log(share / (1 - share)))
    seen_bias, seen_linear, seen_factors = 1e-6, np.full(n_inputs, 1e-6), np.full((n_inputs, factors), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(described))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            index, value, starts = machine.inputs([described[i] for i in chosen])
            margins, sums = machine.margins(index, value, starts)
            error = (1 / (1 + np.exp(-np.clip(margins, -30, 30))) - labels[chosen]) / len(chosen)
            row = np.repeat(np.arange(len(chosen)), np.diff(np.append(starts, len(index))))
            used, place = np.unique(index, return_inverse=True)
            pull = error[row] * value
            step = np.bincount(place, pull, len(used)) + decay * machine.linear[used]
            seen_linear[used] += step * step
            each = pull[:, None] * (sums[row] - machine.factors[index] * value[:, None])
            wide = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(factors)], axis=1) + decay * machine.factors[used]
            seen_factors[used] += wide * wide
            machine.linear[used] -= rate * step / np.sqrt(seen_linear[used])
            machine.factors[used] -= rate * wide / np.sqrt(seen_factors[used])
            seen_bias += error.sum() ** 2
            machine.bias -= rate * error.sum() / np.sqrt(seen_bias)
    return machine


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = 6000, **settings) -> Machine:
    """Fits on at most ``most`` labelled documents outside the held-out third, the first by a hash of the id.

    Repeated labels of an id count once (the largest), repeated documents once (the least text); NULL
    labels and ids are left out. What reaches the driver is bounded by ``most``.
    """
    importable(docs.sparkSession)
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max(target).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = _texts(docs).select("doc_id", "text", "n_chars").join(F.broadcast(sample), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"), F.max("n_chars").alias("n_chars"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [describe(t, c) for t, c in zip(b["text"], b["n_chars"])]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "label": b["label"], "i": [d[0].tobytes() for d in out], "w": [d[1].tobytes() for d in out], "s": [d[2].tobytes() for d in out]
            })

    found = rows.mapInPandas(features, "doc_id long, label double, i binary, w binary, s binary").toPandas().sort_values("doc_id")
    described = [(np.frombuffer(i, np.int32), np.frombuffer(w), np.frombuffer(s)) for i, w, s in zip(found["i"], found["w"], found["s"])]
    return fit(described, found["label"].to_numpy(dtype=float), **settings)


def _texts(docs: DataFrame) -> DataFrame:
    """Inputs of a score: the whole text, empty where NULL, and the recorded length, else that of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    recorded = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.withColumns({"n_chars": F.coalesce(recorded, F.length(text).cast("double")), "text": text})


def score(docs: DataFrame, machine: Machine) -> Column:
    """The score of each row's text as a column, computed where the row is read."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lengths in batches:
            out = []
            for i in range(0, len(texts), 256):
                out.append(shared.value.scores([describe(t, c) for t, c in zip(texts.iloc[i : i + 256], lengths.iloc[i : i + 256])]))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    text = F.coalesce(F.col("text"), F.lit(""))
    recorded = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return scored(text, F.coalesce(recorded, F.length(text).cast("double")))


def classified(docs: DataFrame, labels: DataFrame, most: int = 6000, **settings) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``.

    NULL texts are scored as empty ones. Language, source, id and labels are no inputs. Without any
    label every score is 0.5; an empty table gives an empty result.
    """
    machine = train(docs, labels, most=most, **settings)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs, machine).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, most: int = 6000, **settings) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    machine = train(docs, labels, most=most, **settings)
    return docs.withColumn("_score", score(docs, machine)).where("_score >= 0.5").drop("_score")
