"""Toxicity by non-negative positive-unlabelled learning over hashed words.

Confirmed toxic texts are the positives, other texts are unlabelled: some of them are toxic too.
With the class prior p the risk is p * R(positives as 1) + max(0, R(unlabelled as 0) -
p * R(positives as 0)), where the bracket estimates the risk of the clean texts and may not fall
below 0 (Kiryo et al. 2017). A linear model in numpy minimises it by Adam with the logistic loss;
where the bracket is below 0, the step goes back up along it, as the paper has it.

A text is the set of its words, lower-cased, and of their beginnings of ``STEMS`` letters, which
catch inflected forms, hashed to ``DIMENSIONS`` places; word counts do not matter. The model keeps
the places whose share among the positives differs from that among the unlabelled by ``CLEAR``
standard errors, so a long text is not toxic by its length alone. Training uses a bounded sample:
at most ``POSITIVES`` and ``UNLABELLED`` texts, first in a seeded order, whose hashed words reach the
driver. The weights, 1 MB, go to the tasks, and every whole text is scored where it is read.

Labels count only where ``crc32(key) % 5`` is not 0; the others are held out. The prior is the
share of toxic rows among the labels that count, unless it is given.

Defined cases: a null or empty text has no words and scores the bias alone; a null key is not held
out and never trains; repeated rows score alike; without a positive label every score is the prior,
or 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanderlens.llm.text import first_rows, seeded_order

BITS = 18
DIMENSIONS = 1 << BITS
POSITIVES = 4000
UNLABELLED = 8000
STEMS = (3, 4, 5, 6, 7)
CLEAR = 4.0
STEPS = 300
RATE = 0.05
DECAY = 5e-4
SEED = 8
WORDS = re.compile(r"\w+")
#: Words that a Python worker remembers.
KNOWN = 200_000


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def places(text: str | None, known: dict[str, tuple[int, ...]]) -> list[int]:
    """The places of the distinct words of a text and of their beginnings."""
    found: set[int] = set()
    for word in set(WORDS.findall((text or "").lower())):
        at = known.get(word)
        if at is None:
            forms = [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]
            at = tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) >> (32 - BITS) for f in forms)
            if len(known) >= KNOWN:
                known.clear()
            known[word] = at
        found.update(at)
    return list(found)


def _hashed(rows: DataFrame, eligible: DataFrame, most: int) -> list[np.ndarray]:
    """The places of the first ``most`` eligible texts in the order of ``o``, on the driver."""

    def hash_all(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            yield pd.DataFrame({"places": [np.array(places(t, known), "<i4").tobytes() for t in batch["text"]]})

    chosen = first_rows(rows, eligible, "o", "text", most).select("text").mapInPandas(hash_all, "places binary")
    return [np.frombuffer(r[0], "<i4") for r in chosen.collect()]


class Sparse:
    """Rows of places, of which ``useful`` ones are kept, as two flat arrays."""

    def __init__(self, rows: list[np.ndarray], useful: np.ndarray):
        kept = [r[useful[r]] for r in rows]
        self.lengths = np.array([len(r) for r in kept])
        self.flat = np.concatenate([*kept, np.empty(0, np.int32)])
        self.row = np.repeat(np.arange(len(kept), dtype=np.int32), self.lengths)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.flat], minlength=len(self.lengths))

    def back(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(by_row, self.lengths), minlength=DIMENSIONS)


def _counts(rows: list[np.ndarray]) -> np.ndarray:
    """In how many rows each place occurs."""
    found = np.zeros(DIMENSIONS, np.int64)
    for row in rows:
        found[row] += 1
    return found


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk."""
    in_p, in_u = _counts(positive), _counts(unlabelled)
    n, k = len(positive), len(unlabelled)
    both = (in_p + in_u) / (n + k)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n + 1 / k))
    useful = np.abs(in_p / n - in_u / k) >= CLEAR * error
    p, u = Sparse(positive, useful), Sparse(unlabelled, useful)
    weights, bias = np.zeros(DIMENSIONS), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    as_clean = lambda z: np.logaddexp(0, z)
    for step in range(1, STEPS + 1):
        zp, zu = p.dot(weights) + bias, u.dot(weights) + bias
        gp, gu = chance(zp), chance(zu)
        clean_risk = as_clean(zu).mean() - prior * as_clean(zp).mean()
        on_clean_u, on_clean_p = gu / len(gu), -prior * gp / len(gp)
        if clean_risk >= 0:
            by_p, by_u = prior * (gp - 1) / len(gp) + on_clean_p, on_clean_u
        else:
            by_p, by_u = -on_clean_p, -on_clean_u
        slope = np.append(p.back(by_p) + u.back(by_u) + DECAY * weights, by_p.sum() + by_u.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - change[:-1], bias - float(change[-1])
    return weights.astype(np.float32), bias


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic",
    prior: float | None = None,
) -> tuple[np.ndarray, float]:
    use = labels.where(~held_out(labels[key]) & labels[key].isNotNull()).select(
        labels[key].alias("key"), labels[toxic].alias("toxic"))
    counts = use.agg(F.count("toxic"), F.count(F.when(F.col("toxic") == 1, 1))).first()
    prior = prior if prior is not None else counts[1] / max(1, counts[0])
    texts = docs.where(~held_out(docs[key]) & docs[key].isNotNull()).select(
        docs[key].alias("key"), docs[text].alias("text"), seeded_order(docs[key], SEED).alias("o"))
    confirmed = use.where("toxic = 1").select("key").distinct()
    positive = _hashed(texts, texts.join(confirmed, "key", "left_semi"), POSITIVES)
    if not positive or not 0 < prior < 1:
        return np.zeros(DIMENSIONS, np.float32), 30.0 if prior >= 1 and positive else -30.0
    unlabelled = _hashed(texts, texts, UNLABELLED)
    return fit(positive, unlabelled, prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted`` for every document."""
    weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def rate(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            z = np.array([float(sent.value[places(t, known)].sum()) for t in batch["text"]]) + bias
            yield batch[["key", "held_out"]].assign(score=1 / (1 + np.exp(-np.clip(z, -30, 30))))

    rows = docs.select(docs[key].alias("key"), held_out(docs[key]).alias("held_out"), docs[text].alias("text"))
    scored = rows.mapInPandas(rate, f"key {dict(docs.dtypes)[key]}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
