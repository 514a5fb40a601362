"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (3 to 5, with word bounds) and of the whole
word, all hashed into one table; a text is the mean of its words' vectors, weighted by the roots of their
counts (a word that a text repeats over and over must not outweigh it), and a softmax layer gives the two classes. Table and layer are trained together, so an unseen misspelling scores through n-grams it shares.

As the layer is linear, a word's share of the logit is one number: scoring looks words up in a bounded cache, makes the
n-grams of all words it lacks at once as arrays, and averages whole texts. N-grams cover a word to its end, however long it is: a text
without white space is one word. Training reads a bounded sample of labelled rows (``max_rows`` rows by hash of doc_id, ``MAX_BYTES`` of text) in
one task, so that neither the sample nor what is made of it reaches the driver; scoring covers every row.

Defined results: null or empty texts get the score of the bias alone; unlabelled rows are never learned from;
a label that is null is no label; repeated labels of one document with different values count both; of labelled rows that share a
doc_id the smallest text is learned from; without any label the score is 0 for all; a null doc_id is not held out and is never learned from; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp, sqrt
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.common import by_bytes, cap_batches, fresh, trim, wider, worker_slot

#: Rows of the sample that the model learns from, at most, and bytes of their texts; a row that would pass these is left out of the sample.
MAX_ROWS = 6000
MAX_BYTES = 64 << 20
#: Words whose shares of the logit a worker keeps.
CACHE_WORDS = 250_000
#: Characters up to which a word is kept there; longer ones are hashed anew each time.
CACHED_CHARS = 64
#: Characters whose n-grams are hashed at once, and bytes of text that are scored together.
CHUNK_CHARS, CHUNK_BYTES = 100_000, 1 << 20

BUCKETS = 1 << 16
DIM = 8
SIZES = (3, 4, 5)
#: Logits are this times the mean's product with the layer: single words must count in long texts.
SCALE = 80.0

# Digits and signs that stand for letters inside words.
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def spelled(word: str) -> str:
    """A word without marks around it, and with stand-in digits and signs inside as letters."""
    word = word.strip(_EDGES)
    if word.isalpha() or not any(c.isalpha() for c in word):
        return word
    return "".join(c for c in word.translate(_LEET) if c.isalnum())


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def grams_of(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the word, table row) of every n-gram of the words, and of the words themselves, in parts of bounded size.

    A table row is zlib.crc32 of the gram's UTF-8 bytes, modulo ``BUCKETS``. Empty words have none.
    """
    marked = [f"<{w}>".encode("utf-8", "surrogatepass") if w else b"" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    some = np.flatnonzero(sizes)
    yield some, np.array([zlib.crc32(marked[i]) for i in some], np.uint32) % np.uint32(BUCKETS)
    data = np.frombuffer(b"".join(marked), np.uint8)
    begin = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each character
    word = np.searchsorted(np.cumsum(sizes), begin[:-1], "right")
    for n in SIZES:
        for at in range(0, len(word) - n + 1, CHUNK_CHARS):
            end = min(at + CHUNK_CHARS, len(word) - n + 1)
            inside = np.flatnonzero(word[at:end] == word[at + n - 1 : end + n - 1]) + at
            start, size = begin[inside], begin[inside + n] - begin[inside]
            crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
            for k in range(int(size.max(initial=0))):
                live = slice(None) if k < n else np.flatnonzero(k < size)
                crc[live] = _CRC[(crc[live] ^ data[start[live] + k]) & 0xFF] ^ (crc[live] >> np.uint32(8))
            yield word[inside], ~crc % np.uint32(BUCKETS)


def ngrams_of(word: str) -> list[int]:
    """Table rows of a word itself and of its n-grams; none for an empty word."""
    return [int(r) for _, rows in grams_of([word]) for r in rows]


@dataclass
class Model:
    """Embedding table, softmax layer and bias. Without labels the layer is absent and scores are 0."""

    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    known: bool = True

    def rows(self) -> np.ndarray:
        """What each table row adds to the logit of a text that holds nothing else."""
        return self.table.astype(np.float64) @ (self.layer[:, 1] - self.layer[:, 0]).astype(np.float64) * SCALE


class Scorer(dict):
    """Scores whole texts; as a dict, keeps words' shares of the logit."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self._known, self._bias, self._rows = model.known, float(model.bias[1] - model.bias[0]), model.rows()

    def _shares(self, words: list[str]) -> list[float]:
        """Each word's mean over its grams; 0 without grams."""
        total, n = np.zeros(len(words)), np.zeros(len(words))
        for word, rows in grams_of(list(map(spelled, words))):
            total += np.bincount(word, self._rows[rows], len(words))
            n += np.bincount(word, minlength=len(words))
        return (total / np.maximum(n, 1)).tolist()

    def scores(self, texts: list[str | None]) -> list[float]:
        """Scores of texts that fit into memory together."""
        if not self._known:
            return [0.0] * len(texts)
        counts = [Counter(words_of(t)) if t else {} for t in texts]
        if len(self) >= CACHE_WORDS:
            self.clear()
        new = list(set().union(*counts) - self.keys())
        shares = dict(zip(new, self._shares(new), strict=True))
        self.update(shares)
        out = []
        for words in counts:
            z = self._bias
            if words:
                roots = list(map(sqrt, words.values()))
                z += sum(map(mul, map(self.__getitem__, words), roots)) / sum(roots)
            out.append(1 / (1 + exp(-min(60.0, max(-60.0, z)))))
        for w in new:
            if len(w) > CACHED_CHARS:
                del self[w]
        return out

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


class Bags:
    """Table rows, their weights and each text's start, for means over words of means over n-grams."""

    def __init__(self) -> None:
        self._rows, self._weights, self._starts = array("H"), array("f"), [0]

    def add(self, text: str) -> None:
        counts = Counter(words_of(text))
        roots = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
        parts = list(grams_of([spelled(w) for w in counts])) if counts else []
        total = np.zeros(BUCKETS)
        if parts:
            n = sum(np.bincount(word, minlength=len(roots)) for word, _ in parts)
            share = roots / roots.sum() / np.maximum(n, 1)
            total = sum(np.bincount(rows, share[word], BUCKETS) for word, rows in parts)
        used = np.flatnonzero(total)
        if not used.size:
            used = np.zeros(1, np.int64)
        self._rows.frombytes(used.astype(np.uint16).tobytes())
        self._weights.frombytes(total[used].astype(np.float32).tobytes())
        self._starts.append(len(self._rows))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(self._rows, np.uint16), np.frombuffer(self._weights, np.float32), np.array(self._starts)


def gradients(table: np.ndarray, layer: np.ndarray, bias: np.ndarray, rows: np.ndarray, weights: np.ndarray, cut: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean cross-entropy of some bags (bag i is rows and weights cut[i] to cut[i + 1]), and its gradients for table, layer and bias."""
    mean = np.add.reduceat(table[rows] * weights[:, None], cut[:-1], axis=0)
    z = SCALE * (mean @ layer) + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-30)).mean())
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    d_mean = SCALE * p @ layer.T
    spread = np.repeat(d_mean, np.diff(cut), axis=0) * weights[:, None]
    d_table = np.stack([np.bincount(rows, spread[:, k], len(table)) for k in range(table.shape[1])], axis=1).astype(table.dtype)
    return loss, d_table, SCALE * mean.T @ p, p.sum(axis=0)


def train(texts: Iterable[str], labels: list[int], epochs: int = 8, rate: float = 0.2, batch: int = 64, seed: int = 7) -> Model:
    """Adagrad on the mean cross-entropy, over mini-batches."""
    bags = Bags()
    for text in texts:
        bags.add(text)
    return train_bags(*bags.arrays(), np.array(labels, np.int64), epochs, rate, batch, seed)


def train_bags(rows: np.ndarray, weights: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.2, batch: int = 64, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)
    layer = (rng.standard_normal((DIM, 2)) * 0.3).astype(np.float32)
    bias = np.zeros(2, np.float32)
    if not len(y):
        return Model(table, layer, bias, False)
    bias[1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    params = (table, layer, bias)
    sums = [np.full(x.shape, 1e-6, np.float32) for x in params]
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            spans = [slice(starts[i], starts[i + 1]) for i in some]
            cut = np.cumsum([0, *(s.stop - s.start for s in spans)])
            _, *slopes = gradients(*params, np.concatenate([rows[s] for s in spans]), np.concatenate([weights[s] for s in spans]), cut, y[some])
            for x, total, d in zip(params, sums, slopes, strict=True):
                total += d**2
                x -= step * d / np.sqrt(total)
    return Model(table, layer, bias)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Learn, in one task, from at most ``max_rows`` labelled rows that aren't held out and ``max_bytes`` of their texts."""
    label = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("y")).filter("y is not null and l_id is not null")
    chosen = label.filter(~held_out(F.col("l_id"))).distinct().orderBy(F.xxhash64("l_id"), "l_id", "y").limit(max_rows).toArrow()  # ids and labels alone
    if not chosen.num_rows:
        return train([], [])
    known = F.broadcast(docs.sparkSession.createDataFrame(chosen))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = docs.select(F.col("doc_id").cast("long").alias("l_id"), text.alias("text")).join(known, "l_id").groupBy("l_id", "y").agg(F.min("text").alias("text"))
    cap_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, y, size = Bags(), [], 0
        for b in batches:
            for label, text in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                more = len(text.as_buffer())
                if size + more <= max_bytes:
                    bags.add(text.as_py())
                    y.append(label)
                    size += more
        m = train_bags(*bags.arrays(), np.array(y, np.int64))
        del bags
        trim()
        yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in (m.table, m.layer, m.bias)), pa.array([m.known])], ["table", "layer", "bias", "known"])

    rows = sample.repartition(1).sortWithinPartitions(F.xxhash64("l_id"), "y").mapInArrow(run, "table binary, layer binary, bias binary, known boolean").collect()
    if not rows:  # no labelled document: no task ran
        return train([], [])
    table, layer, bias, known = rows[0]
    shaped = lambda x, *shape: np.frombuffer(x, np.float32).reshape(shape)
    return Model(shaped(table, BUCKETS, DIM), shaped(layer, DIM, 2), shaped(bias, 2), known)


def _with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """The documents' own columns and their score, as column ``name``, in one pass."""
    cap_batches(docs.sparkSession)
    place = docs.columns.index("text")
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.layer, model.bias, model.known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_slot(("scorer", key), lambda: Scorer(Model(*shared.value)))
        for b in batches:
            for part in by_bytes(b, place, CHUNK_BYTES):
                scores = pa.array(scorer.scores(part.column(place).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, name])

    return docs.mapInArrow(run, wider(docs, name, "double"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels, max_rows)
    scored = _with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents, with their own columns, that score below the threshold."""
    score = fresh(docs.columns, "score")
    return _with_score(docs, fit(docs, labels, max_rows), score).filter(F.col(score) < threshold).drop(score)
