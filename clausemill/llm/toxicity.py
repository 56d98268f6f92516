"""A toxicity classifier whose score changes little when identity terms are swapped."""

from __future__ import annotations

import functools
import math
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ftrl import Leader
from .language import drawn

BUCKETS = 1 << 18
#: Labelled texts of each class, about, that the weights are fitted on.
FIT_ROWS = 3_000
EPOCHS = 12
ALPHA, L1, L2 = 1.0, 3.0, 0.01
#: Features in fewer of the fitted texts tell nothing and are left out; so are those in a larger share of them, if their shares
#: in the texts of either class differ by less than ``ALIKE``.
MIN_TEXTS, COMMON_SHARE, ALIKE = 3, 0.3, 0.1
#: Weight of the squared change of the logit between a text and its counterfactual.
FAIRNESS = 2.0
#: Prefix lengths that stand beside each word as features.
PREFIXES = (3, 4, 5, 6, 7)
#: Features that a worker remembers words for.
REMEMBERED = 200_000
WORD = re.compile(r"\w+")

# fixed values: terms for groups of people, by language and kind; a term is swapped for the next of its row
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("wife", "husband"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("disabled", "blind", "deaf"), ("elderly", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("juden", "christen", "muslime"), ("schwule", "lesben"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("femme", "homme"), ("juifs", "chrétiens", "musulmans"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("judíos", "cristianos", "musulmanes"), ("extranjeros", "españoles"),
)


@functools.cache
def swaps() -> dict[str, str]:
    return {term: row[(i + 1) % len(row)] for row in IDENTITY_TERMS for i, term in enumerate(row)}


def counterfactual(words: list[str]) -> list[str] | None:
    """The words with every identity term swapped, or None if there is none."""
    other = swaps()
    return [other.get(w, w) for w in words] if any(w in other for w in words) else None


@functools.lru_cache(maxsize=REMEMBERED)
def features(word: str) -> tuple[int, ...]:
    """Buckets of the word and of its prefixes."""
    parts = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
    return tuple(zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def presence(found: list[str]) -> np.ndarray:
    return np.array(sorted({b for w in set(found) for b in features(w)}), np.int64)


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def scorer(self):
        """Text to score; which of a word's features have a weight is worked out once per word."""
        weights, bias = self.weights, self.bias

        @functools.lru_cache(maxsize=REMEMBERED)
        def weighty(word):
            return tuple(b for b in features(word) if b in weights)

        def score(text):
            hit = set()
            for word in set(words(text)):
                hit.update(weighty(word))
            logit = bias + sum(weights[b] for b in sorted(hit))
            return 1 / (1 + math.exp(-logit)) if logit > -700 else 0.0

        return score


def fit_rows(rows: list[tuple[int, str]], fairness: float = FAIRNESS, prior: float | None = None) -> Model:
    """A model from (label, text) rows in the given order.

    Each text's step follows its log loss; where it holds identity terms, the squared difference between its logit and
    that of the text with swapped terms is added, which pulls the weights of terms of one row towards each other.
    Weights are not negative: a long text's many innocent words don't outweigh what it says elsewhere. ``prior`` is the share of label 1 in the population, if the rows were not drawn in proportion.
    """
    data, texts = [], np.zeros((2, BUCKETS), np.int64)
    for label, text in rows:
        found = words(text)
        other = counterfactual(found)
        data.append((label, presence(found), None if other is None else presence(other)))
        texts[label, data[-1][1]] += 1
    shares = texts / np.maximum(np.bincount([label for label, _ in rows], minlength=2), 1)[:, None]
    every = texts.sum(0)
    useful = (every >= MIN_TEXTS) & ((every <= COMMON_SHARE * len(rows)) | (np.abs(shares[1] - shares[0]) >= ALIKE))
    data = [(y, at[useful[at]], None if other is None else other[useful[other]]) for y, at, other in data]
    leader = Leader(BUCKETS, 1, alpha=ALPHA, l1=L1, l2=L2, positive=True)
    bias = 0.0
    for _ in range(EPOCHS):
        for label, at, swapped in data:
            w = leader.weights(at)
            logit = bias + w.sum()
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))) - label
            bias -= 0.02 * error
            leader.step(at, np.full((len(at), 1), error), w)
            if swapped is not None and fairness:
                only, instead = np.setdiff1d(at, swapped), np.setdiff1d(swapped, at)
                both = np.concatenate([only, instead])
                if len(both):
                    sign = np.concatenate([np.ones(len(only)), -np.ones(len(instead))])[:, None]
                    w = leader.weights(both)
                    change = float((sign * w).sum())
                    leader.step(both, 2 * fairness * change * sign, w)
    final = leader.weights()[:, 0]
    if prior is not None and rows:
        drawn = sum(label for label, _ in rows) / len(rows)
        if 0 < drawn < 1 and 0 < prior < 1:
            bias += math.log(prior / (1 - prior)) - math.log(drawn / (1 - drawn))
    return Model({int(i): float(final[i]) for i in np.flatnonzero(final)}, bias)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows_per: int = FIT_ROWS
) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` marks 0 or 1 (a key marked more than once counts by its highest).

    Class sizes come from all labels; weights from about ``fit_rows_per`` texts of each class, chosen by a hash of the
    key, in one bounded task. Null keys and labels are left out. Without labels of both classes every score is 0.5 or
    near the only class.
    """
    marked = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .filter(F.col("key").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("key").agg(F.max("label").alias("label"))
    )
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not sizes:
        return Model({}, 0.0)
    prior = sizes.get(1, 0) / sum(sizes.values())
    counted = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("label")]
    chosen = drawn(marked.withColumn("count", counted), fit_rows_per).select("key", "label", "turn")
    sample = (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "key")  # about 2 * fit_rows_per rows at most
        .dropDuplicates(["key"])
        .withColumn("task", F.lit(0))
    )

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "key"])
        rows = list(zip(group["label"].tolist(), group["text"].fillna("").tolist()))
        return pd.DataFrame({"model": [pickle.dumps(fit_rows(rows, prior=prior))]})

    model = sample.groupBy("task").applyInPandas(learn, "model binary").collect()
    return pickle.loads(model[0]["model"]) if model else Model({}, 0.0)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``score`` of each row's whole text, row by row and without a shuffle.

    A null or empty text has the score of a text without any known feature.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(text).alias("text"))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value.scorer()
        for texts in batches:
            yield pd.Series([scorer(t) for t in texts], dtype="float64")

    return kept.select("kept.*", scored("text").alias("score"))
