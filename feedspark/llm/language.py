"""Operator 9: language identification by nearest centroid.

A whole text, lower-cased and with marks and digits as spaces, is a vector of its character n-grams of lengths 1 to 3, hashed into DIM buckets;
a bucket weighs (1 + ln n-gram count) * idf, and vectors have length 1. The idf counts cover all rows that may
be learned from. On a bounded sample of each language, spherical k-means gives several centroids a language;
a text gets the language of the centroid of highest cosine, which is its score. A text whose cosine lies
below REJECT times the lowest seen for snippets of its length in the sample is marked rejected (its language
is still named).

Defined results: a null text and a text without a letter get ``und``, score 0 and rejected; every input row
gives one output row (repeated rows and null ids included); rows with a null language or null id are not learned
from; without any such row all is ``und``; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, read, slices, texts
from .sampling import class_sample

BITS, NGRAMS = 12, 3
DIM = 1 << BITS
#: Bound of the sample that centroids are fitted on; centroids and rounds of each language.
SAMPLE_PER_LANGUAGE, CENTROIDS, ROUNDS, SEED = 800, 4, 12, 5
#: Share of the lowest cosine of sample snippets of like length below which a text is rejected.
REJECT = 0.6
#: Odd multipliers of the n-gram hash.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Marks and digits of the first alphabets count as spaces.
LETTERS = np.array([i if chr(i).isalpha() else 32 for i in range(0x370)], np.uint32)
LETTER = regex.compile(r"\p{L}")
SIZES = 24


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams (texts by DIM)."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(codes < len(LETTERS), LETTERS[np.minimum(codes, len(LETTERS) - 1)], codes)
    n = np.array([len(t) + 2 for t in lowered], np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) << BITS, n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(codes))  # characters from here to the text's end
    out = np.zeros(len(texts) << BITS, np.int64)
    h = np.zeros(len(codes), np.uint32)
    for k in range(NGRAMS):
        h = h[:len(codes) - k] + codes[k:] * np.uint32(MULTIPLIERS[k])
        bucket = ((h * np.uint32(0x27D4EB2F)) ^ np.uint32(k * 0x165667B1)) >> np.uint32(32 - BITS)
        whole = left[:len(h)] > k
        out += np.bincount((row[:len(h)] + bucket)[whole], minlength=len(out))
        h = h[:max(0, len(codes) - k - 1)]
    return out.reshape(len(texts), DIM)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    c = gram_counts(texts).astype(np.float32)
    np.log1p(c, out=c, where=c > 0)
    c *= idf
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def size_class(text: str) -> int:
    return min(SIZES - 1, len(text).bit_length())


def clusters(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Spherical k-means; at most k centroids of length 1."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([s / max(np.linalg.norm(s), 1e-12) if (near == j).any() and (s := x[near == j].sum(axis=0)) is not None else c[j] for j in range(k)])
    return c


@dataclass
class Centroids:
    idf: np.ndarray
    centers: np.ndarray      # centroids by DIM
    language: list[str]      # of each centroid
    floor: np.ndarray        # least accepted cosine by size class

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[bool]]:
        lang, score, rejected = [], [], []
        for lo in range(0, len(texts), 128):
            part = texts[lo:lo + 128]
            cos = vectors(part, self.idf) @ self.centers.T
            best = cos.argmax(axis=1)
            for t, b, s in zip(part, best, cos.max(axis=1)):
                if LETTER.search(t):
                    lang.append(self.language[b])
                    score.append(min(1.0, max(0.0, float(s))))
                    rejected.append(bool(s < self.floor[size_class(t)]))
                else:
                    lang.append("und")
                    score.append(0.0)
                    rejected.append(True)
        return lang, np.array(score), rejected


def fit(texts: list[str], langs: list[str], idf: np.ndarray) -> Centroids:
    rng = np.random.default_rng(SEED)
    centers, names, floor = [], [], np.full(SIZES, np.inf)
    for lang in sorted(set(langs)):
        own = [t for t, x in zip(texts, langs) if x == lang]
        x = np.vstack([vectors(own[i:i + 128], idf) for i in range(0, len(own), 128)])
        c = clusters(x, CENTROIDS, rng)
        centers.append(c)
        names += [lang] * len(c)
        # distances of whole texts and of short runs of their words, by length
        runs = []
        for t in own:
            words = t.split()
            n = int(np.exp(rng.uniform(0, np.log(max(2, len(words))))))
            i = int(rng.integers(0, len(words) - n + 1)) if len(words) >= n else 0
            runs.append(" ".join(words[i:i + n]))
        for part in (own, runs):
            for i in range(0, len(part), 128):
                cos = (vectors(part[i:i + 128], idf) @ c.T).max(axis=1)
                for t, s in zip(part[i:i + 128], cos):
                    if LETTER.search(t):
                        floor[size_class(t)] = min(floor[size_class(t)], float(s))
    # a longer text is at least as near as a shorter one: carry floors upwards, and none where nothing was seen below
    least = 0.0
    for j in range(SIZES):
        least = min(floor[j], floor[j + 1:].min(initial=np.inf)) if np.isfinite(floor[j:].min()) else least
        floor[j] = REJECT * least
    floor[:4] = 0.0  # under 8 characters cosine says nothing
    return Centroids(idf, np.vstack(centers), names, floor)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Number of texts that hold each n-gram bucket, and of texts: one partial count a task, summed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in slices(batches, 128):
            df += (gram_counts(texts(batch.column(0))) > 0).sum(axis=0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM), pa.int32()), pa.array(np.append(n, df))], names=["bucket", "n"])

    sums = docs.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM, np.int64)
    total = 0
    for b, n in sums:
        if b < 0:
            total = n
        else:
            df[b] = n
    return df, total


def train(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_class: int = SAMPLE_PER_LANGUAGE) -> Centroids | None:
    """Centroids of the rows for which ``learn`` (a condition on the id) holds and whose language is known."""
    rows = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col)).where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & learn)
    df, total = document_frequencies(rows, text_col)
    if not total:
        return None
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    sample, _ = class_sample(rows, id_col, lang_col, per_class)
    got = sorted(((r[lang_col], str(r[id_col]), r[text_col]) for r in sample.collect()))
    got = [r for r in got if LETTER.search(r[2])]
    return fit([r[2] for r in got], [r[0] for r in got], idf) if got else None


def predictions(model: Centroids | None, part: list[str]) -> tuple[list[str], np.ndarray, list[bool]]:
    return model.predict(part) if model else (["und"] * len(part), np.zeros(len(part)), [True] * len(part))


def identify(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, rejected) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score, rejected = predictions(model, texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                             names=[id_col, "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Centroids | None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that are not rejected."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([not r for r in predictions(model, texts(batch.column(at)))[2]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    return crc32_mod("doc_id", 5) == 0


def op9(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
