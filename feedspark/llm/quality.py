"""Operator 1: quality classifier, a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Learned filters look at overlapping chunks of WIDTH bytes, one at every STRIDE
bytes from the first to past the last, so that the whole document is covered. Responses are max-pooled over
segments of SEGMENT bytes; the document's features are each filter's highest and mean pooled response,
which a logistic unit combines into one probability. A filter is a product of learned byte vectors and
learned weights; for scoring it is a table of 256 responses at each place of the chunk.

The network is fitted on the driver on at most SAMPLE_PER_CLASS texts of each label (a bounded sample by hash
of the id; class weights restore the labels' shares); all documents are scored in one scan, no shuffle.

Defined results: null and empty texts are scored as one segment of padding; every input row gives one output
row (repeated rows and null ids included); labels that are null or of a null id are not learned from; without
any label the score is 1, with labels of one kind it is that kind; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, read, slices, texts
from .sampling import class_sample

WIDTH, STRIDE, SEGMENT, FILTERS, BYTE_DIM = 8, 2, 256, 16, 8
#: Bound of the labelled sample, and of the bytes of it that are learned from at once.
SAMPLE_PER_CLASS, BATCH, EPOCHS, RATE, DECAY = 1500, 48, 14, 0.01, 1e-4
THRESHOLD, SEED = 0.7, 11
#: Least number of steps of a fit.
MIN_STEPS = 800
#: Weight of a short run of words cut from a labelled text, against the text itself.
SNIPPET_WEIGHT = 1.0


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text behind WIDTH zeros (so that no chunk holds bytes of two texts) and padded by zeros to whole
    segments, and each text's number of segments."""
    n = np.array([-(-(len(t) + WIDTH) // SEGMENT) for t in texts], np.int64)
    data = b"".join((bytes(WIDTH) + t).ljust(int(k) * SEGMENT, b"\0") for t, k in zip(texts, n)) + bytes(WIDTH)
    return np.frombuffer(data, np.uint8), n


@dataclass
class Network:
    table: np.ndarray   # WIDTH x 256 x FILTERS: response of a byte at a place of the chunk
    bias: np.ndarray    # FILTERS
    out: np.ndarray     # 2 * FILTERS: weights of the highest and the mean pooled response
    const: float

    def pooled(self, data: np.ndarray, n_seg: int, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Highest response of each filter in each segment and, if asked for, the chunk that gave it."""
        per = SEGMENT // STRIDE
        top = np.empty((n_seg, FILTERS), np.float32)
        at = np.empty((n_seg, FILTERS), np.int64) if where else None
        for lo in range(0, n_seg, 64):  # small enough for the processor's cache
            hi = min(n_seg, lo + 64)
            start, n = lo * SEGMENT, (hi - lo) * per
            z = self.table[0][data[start:start + n * STRIDE:STRIDE]]
            for w in range(1, WIDTH):
                z += self.table[w][data[start + w:start + w + n * STRIDE:STRIDE]]
            z = z.reshape(hi - lo, per, FILTERS)
            if where:
                at[lo:hi] = z.argmax(axis=1)
            top[lo:hi] = z.max(axis=1)
        return np.tanh(top + self.bias), at

    def features(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first = np.cumsum(counts) - counts
        return np.hstack([np.maximum.reduceat(h, first), np.add.reduceat(h, first) / counts[:, None]])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        data, counts = segments(texts)
        h, _ = self.pooled(data, int(counts.sum()))
        z = self.features(h, counts).astype(np.float64) @ self.out + self.const
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def with_snippets(texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts and a short run of whole words of each, so that short documents are learned as well."""
    rng, out, y, w = np.random.default_rng(SEED), list(texts), list(labels), list(weights)
    for text, label, weight in zip(texts, labels, weights):
        words = text.split(b" ")
        n = int(np.exp(rng.uniform(0, np.log(40))))
        if len(words) > n:
            i = int(rng.integers(0, len(words) - n))
            out.append(b" ".join(words[i:i + n]))
            y.append(label)
            w.append(weight * SNIPPET_WEIGHT)
    return out, np.array(y), np.array(w)


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Minimise the weighted log loss by Adam; the same input gives the same network."""
    texts, labels, weights = with_snippets(texts, labels, weights)
    rng = np.random.default_rng(SEED)
    p = {"byte": rng.normal(0, 0.3, (256, BYTE_DIM)), "place": rng.normal(0, 0.3, (WIDTH, BYTE_DIM, FILTERS)),
         "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "const": np.zeros(1)}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    epochs = max(epochs, -(-MIN_STEPS * BATCH // len(texts)))  # a small sample is gone through more often
    total = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            some = order[lo:lo + BATCH]
            data, counts = segments([texts[i] for i in some])
            net = Network((p["byte"] @ p["place"]).astype(np.float32), p["bias"].astype(np.float32), p["out"], float(p["const"][0]))
            n_seg = int(counts.sum())
            h, at = net.pooled(data, n_seg, where=True)
            x = net.features(h, counts).astype(np.float64)
            score = 1 / (1 + np.exp(-np.clip(x @ p["out"] + p["const"], -60, 60)))
            err = (score - labels[some]) * weights[some] / weights[some].sum()
            doc = np.repeat(np.arange(len(some)), counts)
            highest = h == x[doc, :FILTERS].astype(np.float32)
            dh = err[doc, None] * (p["out"][:FILTERS] * highest + p["out"][FILTERS:] / counts[doc, None])
            ds = dh * (1 - h.astype(np.float64) ** 2)
            first = np.arange(n_seg)[:, None] * SEGMENT + at * STRIDE
            dt = np.stack([np.bincount((data[first + w].astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), ds.ravel(),
                                       256 * FILTERS).reshape(256, FILTERS) for w in range(WIDTH)])
            grad = {"byte": np.einsum("wbf,wdf->bd", dt, p["place"]), "place": np.einsum("bd,wbf->wdf", p["byte"], dt),
                    "bias": ds.sum(axis=0), "out": x.T @ err, "const": np.array([err.sum()])}
            step += 1
            rate = RATE * (1 - (step - 1) / total)
            for k in p:
                g = grad[k] + DECAY * p[k] * (k != "const")
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network((p["byte"] @ p["place"]).astype(np.float32), p["bias"].astype(np.float32), p["out"], float(p["const"][0]))


def train(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          per_class: int = SAMPLE_PER_CLASS) -> Network | float:
    """Network of the labels of rows for which ``learn`` (a condition on the id) holds, or a constant score where there is nothing to tell apart."""
    marks = labels.select(id_col, F.col(label_col).cast("int").alias("__label")).where(
        F.col(id_col).isNotNull() & F.col("__label").isin(0, 1) & learn).distinct()
    ids, shares = class_sample(marks, id_col, "__label", per_class)
    if len(shares) < 2:
        return float(next(iter(shares), 1))
    # ids: at most 2 * per_class rows, so broadcasting them is bounded
    rows = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(ids), id_col).groupBy(id_col, "__label").agg(
        F.min("__text").alias("__text")).collect()
    rows.sort(key=lambda r: (str(r[0]), r[1]))
    if len({r["__label"] for r in rows}) < 2:
        return float(next((r["__label"] for r in rows), 1))
    y = np.array([r["__label"] for r in rows], float)
    w = np.where(y == 1, shares[1] / max(1, y.sum()), shares[0] / max(1, (1 - y).sum()))
    return fit([(r["__text"] or "").encode("utf-8") for r in rows], y, w / w.mean())


def score(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = scores(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def scores(model: Network | float, column: pa.Array) -> np.ndarray:
    data = [t.encode("utf-8") for t in texts(column)]
    return model.scores(data) if isinstance(model, Network) else np.full(len(data), model)


def keep_good(docs: DataFrame, model: Network | float, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(scores(model, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    return crc32_mod("doc_id", 4) == 2


def op1(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                     F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
