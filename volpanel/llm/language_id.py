"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased letters of a text, with runs of anything else as one
space. Document frequencies are counted over all training documents and whole texts. Weights are trained with
follow-the-regularised-leader, per-coordinate steps and elastic-net penalties, on a sample of ``MAX_TRAINING``
distinct labelled texts at most, an equal share per language (one text at least); a fifth of the sample is set aside to fit the
temperature that calibrates the scores. Only the model, whose size the number of hashed features bounds, leaves
the executors.

Defined cases: text that is null or has no letter is ``und`` with score 0; so is every text if no language can be
learned; null languages don't train; ties go to the language that sorts first; repeated rows are predicted each;
extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.llm.tables import map_batches, stage

BITS = 15
#: Bound on the distinct labelled texts that the weights and the temperature are fitted on.
MAX_TRAINING = 6_000
UNDETERMINED = "und"
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of the whole text and their counts; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    chars = np.where(letter, points, np.uint32(32))[keep]
    chars = np.concatenate([[32], chars, [32]]).astype(np.uint32)
    with np.errstate(over="ignore"):
        one = chars * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(31) + chars[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(37) + chars[2:] * np.uint32(0xC2B2AE3D)
        hashed = np.concatenate([one, two, three])
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    slots = hashed >> np.uint32(32 - BITS)
    if len(slots) < 4000:
        return np.unique(slots, return_counts=True)
    counts = np.bincount(slots, minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def tf_idf(counted: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of length one: logarithmic counts times inverse document frequency."""
    slots, counts = counted
    values = (1.0 + np.log(counts)) * idf[slots]
    return slots, values / np.sqrt(values @ values)


@dataclass
class Model:
    """Languages in order, inverse document frequencies, weights (feature x language), biases, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def scores(self, text: str | None) -> tuple[str, float]:
        counted = ngram_counts(text) if self.languages else None
        if counted is None:
            return UNDETERMINED, 0.0
        slots, values = tf_idf(counted, self.idf)
        p = _softmax((values @ self.weights[slots]) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    n_languages: int,
    epochs: int = 3,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
) -> np.ndarray:
    """Sparse weights by follow-the-regularised-leader with an elastic-net penalty."""
    z = np.zeros((1 << BITS, n_languages))
    n = np.zeros_like(z)

    def solved(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0.0)
        return -shrunk / ((beta + np.sqrt(ns)) / alpha + l2)

    for _ in range(epochs):
        for slots, values, label in rows:
            zs, ns = z[slots], n[slots]
            w = solved(zs, ns)
            p = _softmax(values @ w)
            p[label] -= 1.0
            g = values[:, None] * p
            grown = ns + g * g
            z[slots] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / alpha * w
            n[slots] = grown
    return solved(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the least negative log-likelihood, by golden-section search on its logarithm."""

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean()

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", max_training: int = MAX_TRAINING) -> Model:
    """Learn from all rows of ``docs`` with a language: statistics from all of them, weights from the sample."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    languages = sorted(texts)
    if not languages:
        return Model([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), 1.0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for value in batch["text"]:
                counted = ngram_counts(value)
                if counted is not None:
                    seen[counted[0]] += 1
                    total += 1
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"slot": np.append(found, -1), "n": np.append(seen[found], total)})

    frequency = rows.select("text").mapInPandas(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    seen, total = np.zeros(1 << BITS), 0
    for r in frequency.collect():  # one row per hashed feature at most
        if r["slot"] < 0:
            total = r["n"]
        else:
            seen[r["slot"]] = r["n"]
    idf = np.log((1.0 + total) / (1.0 + seen)) + 1.0

    # Copies of a text count once, and each language has its own bound, so no text or language crowds out another.
    share = max(1, max_training // len(languages))
    # Enough are drawn that a language with its share of texts falls short of it by no realistic chance.
    enough = share + 6 * share**0.5 + 10
    rates = F.create_map(*[F.lit(x) for k, n in texts.items() for x in (k, float(min(1.0, enough / n)))])
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "text"))
    drawn = rows.where(draw < rates[F.col("lang")]).distinct()
    sample = drawn.withColumn("first", first).where(F.col("first") <= share)
    index = {k: i for i, k in enumerate(languages)}

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value, language in zip(batch["text"], batch["lang"]):
                counted = ngram_counts(value)
                if counted is not None:
                    slots, values = tf_idf(counted, idf)
                    out.append((1, index[language], slots.astype(np.int32).tobytes(), values.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["one", "label", "slots", "values"])

    def train(batch: pd.DataFrame) -> pd.DataFrame:
        rows_ = sorted(zip(batch["slots"], batch["values"], batch["label"]))
        examples = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32).astype(float), int(k)) for s, v, k in rows_]
        order = np.random.default_rng(7).permutation(len(examples))
        aside = [examples[i] for i in order[: len(order) // 5]]
        weights = train_ftrl([examples[i] for i in order[len(order) // 5 :]], len(languages))
        temperature = 1.0
        if aside:
            logits = np.stack([v @ weights[s] for s, v, _ in aside])
            temperature = fit_temperature(logits, np.array([k for _, _, k in aside]))
        used = np.flatnonzero(np.abs(weights).sum(axis=1))
        return pd.DataFrame({"model": [pickle.dumps((used, weights[used], temperature))]})

    vectors = stage(sample.mapInPandas(features, "one int, label int, slots binary, values binary"), "language-sample")
    fitted = vectors.groupBy("one").applyInPandas(train, "model binary").collect()
    weights, temperature = np.zeros((1 << BITS, len(languages))), 1.0
    if fitted:
        used, found, temperature = pickle.loads(bytes(fitted[0]["model"]))
        weights[used] = found
    return Model(languages, idf, weights, temperature)


def predict(docs: DataFrame, model: Model, *keep: Column, text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*keep, F.col(text).alias("_text"))
    names = given.columns[:-1]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.scores(value) for value in batch["_text"]]
            yield batch[names].assign(lang_pred=[k for k, _ in found], score=[p for _, p in found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInPandas(scored, f"{fields}, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, min_score: float, text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text has a language with at least ``min_score``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scores(value.as_py()) for value in batch.column(at)]
            yield batch.filter(pa.array([k != UNDETERMINED and p >= min_score for k, p in found], pa.bool_()))

    return map_batches(docs, accepted, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: CRC-32 of the id as text, modulo 3, is 1; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows outside the held-out fold and predict every row: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out(F.col(doc_id))), text, lang)
    out = F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out")
    return predict(docs, model, *out, text=text)
