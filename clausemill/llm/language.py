"""Language identification by sparse multinomial regression on TF-IDF weights of character n-grams."""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.session import cut_lineage

from .ftrl import Leader, softmax, temperature

#: Hash buckets of n-grams, and the lengths of n-grams.
BUCKETS = 1 << 16
LENGTHS = (1, 2, 3)
#: Labelled texts per language, about, that the weights are fitted on, and of all languages together; document frequencies
#: count all. With more languages than fit in, each has fewer texts, and one at least.
FIT_ROWS = 1_200
ALL_FIT_ROWS = 64 * FIT_ROWS
EPOCHS = 3
#: Every such text of the fitted ones is set aside for the temperature.
CALIBRATION_EVERY = 5
#: Weighs relative term frequencies, which are small numbers, up to the scale of the learning rate.
SCALE = 40.0
#: Characters handled at a time; a longer text is summed up piece by piece.
PIECE = 1 << 20
UNDETERMINED = "und"


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def codes(text: str) -> np.ndarray:
    """Lower-case letters with one space around and between stretches of them; empty without any letter."""
    raw = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    raw = np.concatenate(([32], raw, [32])).astype(np.uint64)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    out = raw[keep]
    return out if len(out) > 2 or (len(out) and out[0] != 32) else out[:0]


def grams(letters_: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of all n-grams, an array per length."""
    mix = np.zeros(len(letters_), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(letters_) < n:
            return
        mix = (mix[: len(letters_) - n + 1] ^ letters_[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(31)
        if n in LENGTHS:
            yield ((mix * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def pieces(letters_: np.ndarray) -> Iterator[np.ndarray]:
    """The n-grams' buckets in arrays of bounded length: stretches overlap, and each n-gram counts where it starts."""
    for start in range(0, len(letters_), PIECE):
        for found in grams(letters_[start : start + PIECE + max(LENGTHS) - 1]):
            yield found[:PIECE]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    """Weight times inverse document frequency, bucket x language."""
    bias: np.ndarray
    temperature: float

    def logits(self, letters_: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(self.languages)), 0
        for found in pieces(letters_):
            total += self.table[found].sum(axis=0, dtype=np.float64)
            count += len(found)
        return self.bias + SCALE * total / max(count, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = codes(text or "")
        if not len(found) or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(found) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def counts(letters_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of all its n-grams."""
    total = np.zeros(BUCKETS, np.int64)
    for found in pieces(letters_):
        total += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at] / max(1, total.sum())


def document_frequencies(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Texts per bucket, and texts with a letter, over all rows: one row per task and bucket is shuffled."""

    def count(batches):
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for value in batch[text]:
                found = codes(value or "")
                if len(found):
                    rows += 1
                    flags = np.zeros(BUCKETS, bool)
                    for buckets in pieces(found):
                        flags[buckets] = True
                    seen += flags
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(seen[at], rows)})

    parts = texts.select(text).mapInPandas(count, "bucket long, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, rows = np.zeros(BUCKETS), 0
    for r in found:
        if r["bucket"] < 0:
            rows = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, rows


def fit_rows(rows: list[tuple[str, str]], idf: np.ndarray) -> Model:
    """A model from (language, text) rows, in the order given."""
    languages = sorted({label for label, _ in rows})
    place = {label: i for i, label in enumerate(languages)}
    leader, bias = Leader(BUCKETS, len(languages)), np.zeros(len(languages))
    data = []
    for label, value in rows:
        found = codes(value)
        if len(found):
            at, share = counts(found)
            data.append((place[label], at, (SCALE * share * idf[at])[:, None]))
    train = [d for i, d in enumerate(data) if i % CALIBRATION_EVERY or len(data) < 2 * CALIBRATION_EVERY]
    for _ in range(EPOCHS):
        for label, at, x in train:
            w = leader.weights(at)
            error = softmax(bias + (w * x).sum(axis=0))
            error[label] -= 1
            bias -= 0.02 * error
            leader.step(at, error[None, :] * x, w)
    weights = leader.weights()
    aside = [d for i, d in enumerate(data) if not i % CALIBRATION_EVERY] or train
    logits = np.array([bias + (weights[at] * x).sum(axis=0) for _, at, x in aside]).reshape(-1, len(languages))
    t = temperature(logits, np.array([d[0] for d in aside], int)) if len(aside) else 1.0
    return Model(languages, (weights * idf[:, None]).astype(np.float32), bias, t)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows_per: int = FIT_ROWS) -> Model:
    """Learn from all rows of ``docs`` with a label; rows without one only count as texts nowhere.

    Document frequencies come from every labelled text. Weights and temperature come from about ``fit_rows_per``
    texts of each label, chosen by a hash of the key, in one task: every label is learned, from fewer texts each where
    there would be more than ``ALL_FIT_ROWS`` of them. The task holds two numbers per bucket and label (1 MB a label).
    Without any labelled text the model has no languages and finds every text undetermined.
    """
    labelled = docs.filter(F.col(lang).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("label")
    )
    df, rows = document_frequencies(labelled, "text")
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + rows) / (1 + df)) + 1
    sizes = cut_lineage(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.min(F.when(F.col("key").isNotNull(), turn_of())).alias("first")))
    wanted = max(1, min(fit_rows_per, ALL_FIT_ROWS // max(1, sizes.count())))
    keyed = labelled.select("key", "label").join(F.broadcast(sizes), "label")
    lowest = keyed.withColumn("turn", turn_of()).filter("turn = first")  # a label may have none of the rows drawn
    chosen = drawn(keyed, wanted).unionByName(lowest).select("key", "label", "turn").distinct()
    sample = (
        labelled.join(F.broadcast(chosen), ["key", "label"])  # about ALL_FIT_ROWS rows at most, or one per label
        .dropDuplicates(["key", "label"])
        .withColumn("task", F.lit(0))
    )
    shared_idf = docs.sparkSession.sparkContext.broadcast(idf)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "key", "label"])
        values = zip(group["label"], group["text"].fillna(""))
        return pd.DataFrame({"model": [pickle.dumps(fit_rows(list(values), shared_idf.value))]})

    model = sample.groupBy("task").applyInPandas(learn, "model binary").collect()
    return pickle.loads(model[0]["model"]) if model else Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` of each row's whole text, without a shuffle.

    A null text, or one without letters, is ``und`` with score 0. Rows are scored one by one, so keys may be null or
    repeat. ``score`` is the calibrated probability of the predicted language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(text).alias("text"))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        held = shared.value
        return pd.DataFrame([held.predict(t) for t in texts], columns=["lang_pred", "score"])

    return kept.select("kept", predict("text").alias("found")).select("kept.*", "found.*")


def turn_of() -> Column:
    """The random number of a row, from the hash of its ``key``."""
    return F.pmod(F.xxhash64("key"), F.lit(1 << 30))


def drawn(rows: DataFrame, wanted: int) -> DataFrame:
    """About ``wanted`` rows of each group of ``count`` rows, all of a smaller one, by a hash of ``key``, with a random
    ``turn`` from the same hash; rows with a null key are left out. No group is gathered for that."""
    return rows.filter(F.col("key").isNotNull()).withColumn("turn", turn_of()).filter(F.col("turn") * F.col("count") < F.lit(wanted * (1 << 30)).cast("decimal(38,0)"))


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether the key belongs to the part that nothing is learnt from; null keys do not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))
