"""Quality classifier with supervised subword embeddings.

Words, their character n-grams and n-grams of neighbouring words are hashed to rows of one embedding
table, as is one mark for all pairs of equal neighbours, which hashed pairs of rare words can't show; a document is the average of its features' rows, and a linear layer with softmax turns it
into two class probabilities. Table and layer are learned together by stochastic gradient descent in
NumPy on a bounded sample of labelled documents. Scoring streams all documents past the broadcast
model, whose size is fixed by its parameters.
"""

from __future__ import annotations

import dataclasses
import sys
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words whose features one Python worker remembers; beyond it forgets all and starts anew.
WORDS_KEPT = 300_000
END, SAME = b"</s>", b"</same>"


@dataclasses.dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dim: int = 8
    gram_from: int = 3
    gram_to: int = 4
    word_grams: int = 2
    mark_repeats: bool = True
    steps: int = 800
    batch: int = 24
    rate: float = 20.0
    seed: int = 7


def features(word: bytes, s: Settings) -> list[int]:
    """Buckets of a word and of the character n-grams of the word with its edges marked."""
    found = [xxhash.xxh32_intdigest(word, 1) & s.buckets - 1]
    if word in (END, SAME):
        return found
    marked = f"<{word.decode('utf-8', 'replace')}>"
    for n in range(s.gram_from, s.gram_to + 1):
        for i in range(len(marked) - n + 1):
            found.append(xxhash.xxh32_intdigest(marked[i:i + n], 2) & s.buckets - 1)
    return found


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 3)


def word_gram_buckets(hashes: np.ndarray, s: Settings) -> np.ndarray:
    """Buckets of the n-grams of two to word_grams neighbouring words, from the words' hashes."""
    found, gram = [np.empty(0, np.int64)], hashes
    for n in range(2, s.word_grams + 1):
        if len(hashes) < n:
            break
        # Odd factors, modulo 2^64; the order of the words counts.
        gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[n - 1:]
        mixed = (gram ^ gram >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        found.append((mixed >> np.uint64(32)).astype(np.int64) & s.buckets - 1)
    return np.concatenate(found)


def words_of(text: str | None) -> list[bytes]:
    """Words, and a last mark that every document has, so that an empty text has a feature."""
    return [*(text or "").encode("utf-8", "surrogatepass").split(), END]


def bag(text: str | None, s: Settings, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares of all its features."""
    rows, hashes = [], []
    for word in words_of(text):
        row = known.get(word)
        if row is None:
            row = known[word] = np.array(features(word, s), np.int64), word_hash(word)
        rows.append(row[0])
        hashes.append(row[1])
    plain = np.array(hashes[:-1], np.uint64)
    rows.append(word_gram_buckets(plain, s))
    if s.mark_repeats:
        rows.append(np.repeat(features(SAME, s), np.count_nonzero(plain[1:] == plain[:-1])))
    found, counts = np.unique(np.concatenate(rows), return_counts=True)
    return found, (counts / counts.sum()).astype(np.float32)


@dataclasses.dataclass
class Model:
    settings: Settings
    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def slopes(self) -> np.ndarray:
        """What each feature adds to the difference of the two classes' logits."""
        return (self.table @ (self.layer[1] - self.layer[0])).astype(np.float64)


def gradients(model: Model, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray,
              weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The batch's mean weighted cross entropy, its features, and the slopes of the loss along their
    rows, the layer and the bias."""
    index = np.concatenate([b[0] for b in bags])
    value = np.concatenate([b[1] for b in bags])
    sizes = np.array([len(b[0]) for b in bags])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    means = np.add.reduceat(model.table[index] * value[:, None], starts, axis=0)
    logits = means @ model.layer.T + model.bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    own = np.arange(len(bags)), y
    loss = float(-(weight * np.log(np.maximum(p[own], 1e-30))).mean())
    p[own] -= 1
    error = p * weight[:, None] / len(bags)
    distinct, where = np.unique(index, return_inverse=True)
    spread = np.repeat(error @ model.layer, sizes, axis=0) * value[:, None]
    along = np.stack([np.bincount(where, spread[:, d], len(distinct))
                      for d in range(spread.shape[1])], axis=1)
    return loss, distinct, along, error.T @ means, error.sum(axis=0)


def train(texts: list[str | None], labels: list[int], s: Settings) -> Model:
    """Classes weigh alike. The rate falls linearly to zero, as usual for this model."""
    rng = np.random.default_rng(s.seed)
    model = Model(s, rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32),
                  np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32))
    if not texts:
        return model
    known: dict = {}
    bags = []
    for text in texts:
        bags.append(bag(text, s, known))
        if len(known) > WORDS_KEPT:
            known.clear()
    y = np.array(labels, np.int64)
    share = np.bincount(y, minlength=2) / len(y)
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0.0)[y].astype(np.float32)
    step = 0
    while step < s.steps:
        order = rng.permutation(len(y))
        for at in range(0, min(len(order), (s.steps - step) * s.batch), s.batch):
            rows = order[at:at + s.batch]
            _, distinct, along, layer, bias = gradients(
                model, [bags[i] for i in rows], y[rows], weight[rows])
            rate = s.rate * (1 - step / s.steps)
            step += 1
            model.layer -= np.float32(rate * 0.05) * layer
            model.bias -= np.float32(rate * 0.05) * bias
            model.table[distinct] -= (rate * along).astype(np.float32)
    return model


class Remembered:
    """What scoring needs of each word: the sum of its features' slopes, their number, its hash."""

    def __init__(self, slopes: np.ndarray, settings: Settings):
        self.slopes, self.settings = slopes, settings
        self.same = slopes[features(SAME, settings)[0]]
        self.at: dict[bytes, int] = {}
        self.sums, self.sizes, self.hashes = (
            np.empty(1024), np.empty(1024, np.int64), np.empty(1024, np.uint64))

    def add(self, words: list[bytes]) -> None:
        first, last = len(self.at), len(self.at) + len(words)
        if last > len(self.sums):
            self.sums, self.sizes, self.hashes = (
                np.resize(x, 2 * last) for x in (self.sums, self.sizes, self.hashes))
        rows = [features(word, self.settings) for word in words]
        sizes = np.array(list(map(len, rows)))
        self.sizes[first:last] = sizes
        self.sums[first:last] = np.add.reduceat(
            self.slopes[list(chain.from_iterable(rows))], np.cumsum(sizes) - sizes)
        self.hashes[first:last] = np.array(list(map(word_hash, words)), np.uint64)
        self.at.update(zip(words, range(first, last), strict=True))

    def margin(self, text: str | None) -> float:
        """The mean slope of a text's features."""
        words = words_of(text)
        if new := [w for w in dict.fromkeys(words) if w not in self.at]:
            self.add(new)
        where = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        plain = self.hashes[where[:-1]]
        grams = word_gram_buckets(plain, self.settings)
        same = np.count_nonzero(plain[1:] == plain[:-1]) if self.settings.mark_repeats else 0
        total = self.sums[where].sum() + self.slopes[grams].sum() + same * self.same
        count = int(self.sizes[where].sum()) + len(grams) + same
        if len(self.at) > WORDS_KEPT:
            self.at.clear()
        return total / count


def _score(shared, settings: Settings):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slopes, bias = shared.value
        remembered = Remembered(slopes, settings)
        for batch in batches:
            scores = np.array([remembered.margin(text.as_py()) for text in batch.column("text")],
                              np.float64) + bias
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"),
                 pa.array(1 / (1 + np.exp(-np.clip(scores, -700, 700))))],
                names=["doc_id", "text_hash", "score"])
    return run


def held_out(id_column) -> F.Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_training_rows: int = 3_000,
        settings: Settings = Settings()) -> Model:
    """Learns from at most max_training_rows labelled documents that are not held out, those with
    the least hash of their id: the bound of what comes to the driver. Only ids are sorted; the
    texts are found by a broadcast of the chosen ids. Null labels and ids teach nothing; a document
    with two labels counts with each, repeated rows count once."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")) \
        .where(F.col("_label").isNotNull() & F.col("_id").isNotNull()
               & ~held_out(F.col("_id"))).distinct() \
        .orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_training_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(marks), F.col("doc_id") == F.col("_id")) \
        .groupBy("_id", "_label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["_id"], r["_label"]))
    return train([r["text"] for r in rows], [int(r["_label"] > 0) for r in rows], settings)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, text_hash, held_out, score, predicted.

    Only the text is scored, whole, however long. Null counts as an empty text, which has the end
    feature alone. Rows with a null id are not held out. Equal texts have equal scores. An empty table gives an
    empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.slopes(), float(model.bias[1] - model.bias[0])))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(shared, model.settings),
                           "doc_id long, text_hash long, score double") \
        .select("doc_id", "text_hash", held_out(F.col("doc_id")).alias("held_out"), "score",
                (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = 0.3) -> DataFrame:
    """The documents predicted 1, with all their columns."""
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list[pa.RecordBatch] = []

        def views() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                current[:] = [batch]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64()),
                     batch.column(text_col)], names=["doc_id", "text_hash", "text"])

        # One run over all batches, so that words remembered from one serve the next.
        for scored in run(views()):
            yield current[0].filter(pa.array(scored.column("score").to_numpy() >= threshold))

    shared = docs.sparkSession.sparkContext.broadcast(
        (model.slopes(), float(model.bias[1] - model.bias[0])))
    run = _score(shared, model.settings)
    return docs.mapInArrow(keep, docs.schema)
