"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; n-grams of 1 to 4 code points are hashed by array operations into a fixed number
of features; a document is its unit vector of tf * idf. The weights are trained sample by sample with
FTRL-proximal under an elastic net (the L1 part leaves most weights exactly zero, the L2 part shrinks the
rest), and a temperature fitted on texts kept apart from training calibrates the probabilities.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.memory import released

FEATURES = 1 << 15
ORDERS = 4
PER_LANGUAGE = 400  # texts of each language in the training sample, at most
LANGUAGES = 100  # languages learned, at most: those with the most texts
DRAWS = 1_000_000_000
SAMPLE_CHARS = 20_000  # longer texts aren't drawn for training
PIECE = 1 << 18  # code points hashed at once
UNKNOWN = "und"
U32 = np.uint32


def counts(text: str) -> np.ndarray:
    """Number of each hashed n-gram in the whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), U32)
    total = np.zeros(FEATURES)
    for at in range(0, len(points), PIECE):
        part = points[at : at + PIECE + ORDERS - 1]
        h = np.zeros(len(part), U32)
        for n in range(1, ORDERS + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * U32(0x01000193) ^ (part[n - 1 :] * U32(0x9E3779B1))
            m = h[: PIECE] ^ (h[: PIECE] >> U32(15))
            m = (m * U32(0x85EBCA6B)) >> U32(32 - 15)
            total += np.bincount(m, minlength=FEATURES)
    return total


def sparse_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features that a text has, and their numbers, in six bytes each."""
    dense = counts(text)
    at = np.flatnonzero(dense)
    return at.astype(np.uint16), dense[at].astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features by languages
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        x = counts(text) * self.idf
        return x @ self.weights / max(float(np.sqrt(x @ x)), 1e-12) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its calibrated probability; UNKNOWN and 0 without a letter or a model."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], passes: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 3) -> Model:
    """Train on texts with their languages; every fifth text only serves the temperature."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    number = {v: k for k, v in enumerate(names)}
    y = np.array([number[v] for v in langs])
    rows = [sparse_counts(t) for t in texts]
    order = np.random.default_rng(seed).permutation(len(rows))
    apart = order[::5] if len(rows) >= 10 * len(names) else order[:0]
    train = order[np.isin(order, apart, invert=True)]
    seen = np.zeros(FEATURES)
    for i in train:
        seen[rows[i][0]] += 1
    idf = np.log((1 + len(train)) / (1 + seen)) + 1

    def unit(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and values of a text; the last feature is the bias."""
        at, v = rows[i][0].astype(np.int64), rows[i][1] * idf[rows[i][0]]
        return np.append(at, FEATURES), np.append(v / max(np.sqrt(v @ v), 1e-12), 1.0)

    z, n = np.zeros((FEATURES + 1, len(names))), np.zeros((FEATURES + 1, len(names)))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for k in range(passes):
        for i in np.random.default_rng(seed + k).permutation(train):
            at, v = unit(i)
            w = weights(z[at], n[at])
            p = softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    temperature = 1.0
    if len(apart):
        logits = np.stack([v @ w[at] for at, v in map(unit, apart)])
        grid = np.geomspace(0.05, 10, 80)
        temperature = float(min(grid, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(apart)), y[apart]] + 1e-12).sum()))
    return Model(names, idf, w[:FEATURES], w[FEATURES], temperature)


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(id, text, lang): somewhat more than ``per_language`` texts of each of the LANGUAGES most frequent languages,
    among those of 1 to SAMPLE_CHARS characters.

    Drawn by a hash cut-off that follows from a language's number of texts, row by row: nothing is ranked or joined.
    Rows alike in id, text and language are drawn as one.
    """
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.length("text").between(1, SAMPLE_CHARS))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return known.limit(0)
    wanted = 1.25 * per_language + 50
    cutoff = F.create_map(*[c for r in sizes for c in (F.lit(r["lang"]), F.lit(int(DRAWS * min(1.0, wanted / r["n"]))))])
    drawn = known.filter(F.pmod(F.xxhash64("id", "text"), F.lit(DRAWS)) < F.coalesce(cutoff[F.col("lang")], F.lit(0)))
    return drawn.distinct()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` texts of each of the LANGUAGES most frequent languages, drawn by a hash.

    The sample, bounded by LANGUAGES * per_language * SAMPLE_CHARS characters, meets in one task, which keeps
    sparse counts alone; the driver gets the model.
    """

    @released
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((zlib.crc32(f"{r['id']}".encode()), r["id"], r["text"], r["lang"]) for batch in batches for r in batch.to_pylist())
        taken, chosen = Counter(), []
        for _, _, text, lang in sample:
            taken[lang] += 1
            if taken[lang] <= per_language:
                chosen.append((text, lang))
        model = fit([t for t, _ in chosen], [v for _, v in chosen])
        f, k = np.nonzero(model.weights)
        parts = [
            ("language", np.arange(len(model.languages)), None, None, model.languages),
            ("idf", np.arange(FEATURES), None, model.idf, None),
            ("weight", f, k, model.weights[f, k], None),
            ("bias", np.arange(len(model.bias)), None, model.bias, None),
            ("temperature", np.zeros(1, np.int64), None, np.array([model.temperature]), None),
        ]
        for kind, a, b, value, name in parts:
            n = len(a)
            column = lambda x, t: pa.array([None] * n if x is None else x, t)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), column(a, pa.int64()), column(b, pa.int64()), column(value, pa.float64()), column(name, pa.string())], ["kind", "a", "b", "value", "name"])

    got = training_sample(docs, id_col, text_col, lang_col, per_language).repartition(1).mapInArrow(rows, "kind string, a long, b long, value double, name string").toArrow()
    if not got.num_rows:  # an empty sample may start no task
        return fit([], [])
    part = {kind: got.filter(pa.compute.equal(got.column("kind"), kind)) for kind in ("language", "idf", "weight", "bias", "temperature")}
    number = lambda kind, c="value": part[kind].column(c).to_numpy()
    names = dict(zip(number("language", "a").tolist(), part["language"].column("name").to_pylist()))
    out = Model([names[k] for k in range(len(names))], np.zeros(FEATURES), np.zeros((FEATURES, len(names))), np.zeros(len(names)), float(number("temperature")[0]))
    out.idf[number("idf", "a")] = number("idf")
    out.weights[number("weight", "a"), number("weight", "b").astype(np.int64)] = number("weight")
    out.bias[number("bias", "a")] = number("bias")
    return out


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row of docs, repeated and null ids included.

    lang_pred is ``und`` with score 0 for null texts and texts without a letter. Whole texts are read.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, f"`{id_col}` {kind}, lang_pred string, score double")
