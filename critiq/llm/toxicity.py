"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself, all hashed into one table, so
that a misspelling never seen shares most of its vectors with the word it stands for. The vectors of a
window of words are averaged and a linear softmax over the two labels gives its logits; the table and
the softmax are trained jointly by full-batch descent. A long text with one abusive line must not be
averaged away: windows of fixed length cover the whole text, and a text scores as its worst window, in
training (the gradient flows through that window) as in scoring. Averages and softmax are linear in the
subword vectors, so scoring adds up one number per word, and words are looked up in a bounded cache.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import lean_batches
from critiq.llm.memory import Cache, released

BUCKETS = 1 << 18
DIM = 8
WINDOW = 48  # words averaged; windows overlap by half
SAMPLE = 2500  # labelled texts of each label in the training sample, at most
SAMPLE_CHARS = 20_000  # longer texts aren't drawn for training
CACHE = 64 << 20  # bytes of words and their values that a task remembers
WORD = re.compile(r"\w+")


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its n-grams of 3 to 5 characters, with marks for its ends."""
    w = f"<{word}>"
    data = w.encode("utf-8", "surrogatepass")
    if len(data) == len(w):  # a character is a byte
        grams = {data[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)} | {data}
    else:
        grams = {w[i : i + n].encode("utf-8", "surrogatepass") for n in (3, 4, 5) for i in range(len(w) - n + 1)} | {data}
    return [zlib.crc32(g) % BUCKETS for g in grams]


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def window_means(values: np.ndarray) -> np.ndarray:
    """Means over windows that cover all values; the last one is shorter only if it is the only one."""
    if len(values) <= WINDOW:
        return values.mean(axis=0, keepdims=True)
    first = np.append(np.arange(0, len(values) - WINDOW, WINDOW // 2), len(values) - WINDOW)
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
    return (total[first + WINDOW] - total[first]) / WINDOW


@dataclass
class Model:
    value: np.ndarray  # of each bucket: its vector times the difference of the softmax's columns
    bias: float

    def values(self, words: list[str]) -> list[float]:
        """Mean value of the subwords of each word."""
        if not words:
            return []
        grams = [subwords(w) for w in words]
        sizes = np.array([len(g) for g in grams])
        flat = self.value[np.fromiter(chain.from_iterable(grams), np.int64, sizes.sum())]
        return (np.add.reduceat(flat, np.cumsum(sizes) - sizes) / sizes).tolist()

    def score(self, text: str | None, cache: dict[str, float]) -> float:
        """Chance of label 1; a text without words has the bias alone."""
        tokens = words(text)
        logit = self.bias
        if tokens:
            new = [w for w in dict.fromkeys(tokens) if w not in cache]
            cache.update(zip(new, self.values(new)))
            logit += float(window_means(np.fromiter(map(cache.__getitem__, tokens), np.float64, len(tokens))).max())
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def fit(texts: list[str], labels: list[int], steps: int = 300, rate: float = 10.0, least_z: float = 4.5, seed: int = 7) -> Model:
    """Train on texts with labels 0 and 1.

    Only subwords that texts of label 1 hold more often, by ``least_z`` standard errors and in 3 texts at
    least, get a vector; the others keep the zero vector. Without that, vectors of subwords seen in a
    few texts would learn those texts by heart.
    """
    vocabulary: dict[str, int] = {}
    docs, y = [], []
    for t, label in zip(texts, labels):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(t)]
        if ids:
            docs.append(np.array(ids))
            y.append(int(label))
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    nothing = Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    if len(set(y)) < 2:
        return nothing
    y = np.array(y)
    lists = [np.array(subwords(w)) for w in vocabulary]
    held = np.zeros((2, BUCKETS))
    for ids, label in zip(docs, y):
        held[label, np.unique(np.concatenate([lists[i] for i in set(ids.tolist())]))] += 1
    n0, n1 = np.bincount(y)
    p = held.sum(0) / len(y)
    z = (held[1] / n1 - held[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1))
    chosen = np.flatnonzero((z >= least_z) & (held[1] >= 3))
    if not len(chosen):
        return nothing
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    hits = [place[x][place[x] >= 0] for x in lists]
    active = np.flatnonzero([len(h) > 0 for h in hits])
    row = np.full(len(lists), -1)
    row[active] = np.arange(len(active))
    bucket, word = np.concatenate([hits[i] for i in active]), np.repeat(np.arange(len(active)), [len(hits[i]) for i in active])
    length = np.array([len(lists[i]) for i in active])
    # windows of all texts; of their words those with a vector, as (window, word) pairs
    window, token, owner, size = [], [], [], []
    for d, ids in enumerate(docs):
        for s in [0] if len(ids) <= WINDOW else [*range(0, len(ids) - WINDOW, WINDOW // 2), len(ids) - WINDOW]:
            part = row[ids[s : s + WINDOW]]
            token.append(part[part >= 0])
            window.append(np.full(len(token[-1]), len(size)))
            size.append(len(part))
            owner.append(d)
    window, token, owner, size = np.concatenate(window), np.concatenate(token), np.array(owner), np.array(size)
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    rng = np.random.default_rng(seed)
    table, soft, bias = np.zeros((len(chosen), DIM)), rng.normal(0, 1, (DIM, 2)), np.array([0.0, np.log(share / (1 - share))])
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    seen = [np.full_like(v, 1e-10) for v in (table, soft, bias)]
    for _ in range(steps):
        effect = table @ soft  # logits of each subword
        of_word = np.stack([np.bincount(word, effect[bucket, c], len(active)) for c in (0, 1)], 1) / length[:, None]
        logits = np.stack([np.bincount(window, of_word[token, c], len(size)) for c in (0, 1)], 1) / size[:, None] + bias
        margin = logits[:, 1] - logits[:, 0]
        worst = np.maximum.reduceat(margin, begins)
        at = np.flatnonzero(margin == worst[owner])
        at = at[np.concatenate(([True], owner[at][1:] != owner[at][:-1]))]  # one window of each text
        push = (1 / (1 + np.exp(-np.clip(worst, -50, 50))) - y) * weight
        grad = np.stack((-push, push), 1)
        of_window = np.zeros((len(size), 2))
        of_window[at] = grad / size[at, None]
        up = np.stack([np.bincount(token, of_window[window, c], len(active)) for c in (0, 1)], 1) / length[:, None]
        per_bucket = np.stack([np.bincount(bucket, up[word, c], len(chosen)) for c in (0, 1)], 1)
        for now, g, total, pace in ((table, per_bucket @ soft.T, seen[0], rate), (soft, table.T @ per_bucket, seen[1], 0.02), (bias, grad.sum(0), seen[2], 0.05)):
            total += g * g
            now -= pace * g / np.sqrt(total)
    value = np.zeros(BUCKETS)
    value[chosen] = table @ (soft[:, 1] - soft[:, 0])
    return Model(value, float(bias[1] - bias[0]))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> DataFrame:
    """(text, y): for each label the ``per_label`` ids of least hash, among labelled texts of 1 to SAMPLE_CHARS characters.

    Ids with contradicting labels count as 1; null labels don't count.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    marked = marked.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    ids = marked.filter("y = 1").orderBy("h", "id").limit(per_label).unionByName(marked.filter("y = 0").orderBy("h", "id").limit(per_label))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text").between(1, SAMPLE_CHARS))
    return texts.join(F.broadcast(ids.select("id", "y")), "id").select("id", "text", "y")  # 2 * per_label ids at most


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLE) -> Model:
    """Fit on a sample of at most ``per_label`` texts of each label, drawn by a hash of the id.

    The sample, bounded by 2 * per_label * SAMPLE_CHARS characters, meets in one task; the driver gets
    the values of the chosen subwords only.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((r["id"], r["text"], r["y"]) for batch in batches for r in batch.to_pylist())
        model = fit([r[1] for r in sample], [r[2] for r in sample])
        at = np.flatnonzero(model.value)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1, *at.tolist()], pa.int64()), "value": pa.array([model.bias, *model.value[at].tolist()], pa.float64())})

    sample = training_sample(docs, labels, id_col, text_col, label_col, per_label).withColumn("id", F.col("id").cast("long"))
    got = sample.repartition(1).mapInArrow(rows, "bucket long, value double").toArrow()
    if not got.num_rows:  # an empty sample may start no task
        return fit([], [])
    bucket, value = got.column("bucket").to_numpy(), got.column("value").to_numpy()
    out = Model(np.zeros(BUCKETS), float(value[bucket < 0][0]))
    out.value[bucket[bucket >= 0]] = value[bucket >= 0]
    return out


def toxicity_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col: the chance of label 1. All rows and columns are kept, repeated and null ids included.

    Null and empty texts, and texts without a word, score as the model's bias alone. Whole texts are
    read. An empty table gives an empty result; only a column named as score_col is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != score_col]
    place = names.index(text_col)

    @released
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(CACHE)
        for batch in batches:
            out = []
            for text in batch.column(place):
                cache.make_room()
                out.append(shared.value.score(text.as_py(), cache))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*names, score_col])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return lean_batches(docs).select(*(F.col(f"`{c}`") for c in names)).mapInArrow(rows, f"{schema}, `{score_col}` double")
