"""Quality by the votes of nearest labelled neighbours.

Labelled texts become term weights, and these latent-semantic vectors. Every
document is set against all labelled vectors, in blocks of exact cosine
products; its nearest neighbours vote for their label by similarity.

Terms are word shapes (letters folded into classes, other characters as they
are), words that repeat the one before, and hashed words: shapes carry layout
and decoration, words the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_rows, discard, stored, texts_to_python, trimmed

_RUNS = re.compile(r"(.)\1+")
_CLASS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + "bcdefghijklmnopqrstuvwxyz", "A" * 26 + "0" * 10 + "a" * 25)


def shape(token: str) -> str:
    """``Thnd***`` gives ``Aa*``: classes of characters, runs folded into one, eight at most."""
    t = token.translate(_CLASS)
    if not t.isascii():
        t = "".join(c if c < "\x80" else "A" if c.isupper() else "a" if c.isalpha() else c for c in t)
    return _RUNS.sub(r"\1", t)[:8]


@dataclass
class QualityModel:
    """Terms, their projection into latent space, and the labelled vectors."""

    shapes: dict[str, int]
    n_words: int
    weight: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    sharpness: float
    #: Score of a text without terms, and of any text where nothing is labelled.
    base: float

    @property
    def n_terms(self) -> int:
        return len(self.shapes) + 2 + self.n_words


class _Terms(dict):
    """Token -> shape and word in one number."""

    def __init__(self, shapes: dict[str, int], n_words: int):
        self.shapes, self.n_words = shapes, n_words

    def __missing__(self, token: str) -> int:
        at = self.shapes.get(shape(token), len(self.shapes)) * self.n_words + crc32(token.lower().encode()) % self.n_words
        self[token] = at
        return at


class Vectors:
    """Turns texts into latent vectors of unit length (of nothing: zero)."""

    def __init__(self, model: QualityModel, most_kept: int = 100_000):
        self.model, self.most_kept = model, most_kept
        self.terms = _Terms(model.shapes, model.n_words)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        n_shapes = len(m.shapes) + 2
        out = np.zeros((len(texts), m.n_terms), np.float32)
        for row, text in zip(out, texts, strict=True):
            if len(self.terms) > self.most_kept:
                self.terms.clear()
            at = np.array(list(map(self.terms.__getitem__, (text or "").split())), np.int64)
            row[:n_shapes] = np.bincount(at // m.n_words, minlength=n_shapes)
            row[n_shapes - 1] = np.count_nonzero(at[1:] == at[:-1])
            row[n_shapes:] = np.bincount(at % m.n_words, minlength=m.n_words)
            if len(at):
                row /= len(at)
        return out

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        return np.sqrt(counts) * self.model.weight

    def latent(self, counts: np.ndarray) -> np.ndarray:
        v = self.weighted(counts) @ self.model.projection
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def fit_quality_model(texts: list[str | None], labels: list[int], dims: int = 48, neighbours: int = 15, sharpness: float = 8.0, n_words: int = 512, most_shapes: int = 256) -> QualityModel:
    """Learns terms, weights and projection from labelled texts, which become the voters."""
    seen = Counter(s for t in texts for s in shapes_in(t))
    shapes = sorted(seen, key=lambda s: (-seen[s], s))[:most_shapes]
    return model_of_counts(shapes, Vectors(unfitted(shapes, n_words)).counts(texts), labels, dims, neighbours, sharpness, n_words)


def shapes_in(text: str | None) -> set[str]:
    return {shape(w) for w in (text or "").split()}


def unfitted(shapes: list[str], n_words: int, neighbours: int = 0, sharpness: float = 0.0) -> QualityModel:
    """A model that has terms, and nothing else yet."""
    terms = len(shapes) + 2 + n_words
    one, none = np.ones(terms, np.float32), np.zeros((0, 1), np.float32)
    return QualityModel({s: i for i, s in enumerate(shapes)}, n_words, one, np.zeros((terms, 1), np.float32), none, np.zeros(0), neighbours, sharpness, 0.5)


def model_of_counts(shapes: list[str], counts: np.ndarray, labels: list[int], dims: int, neighbours: int, sharpness: float, n_words: int) -> QualityModel:
    """Weights, projection and voters from the shares of terms in labelled texts."""
    model = unfitted(shapes, n_words, neighbours, sharpness)
    model.labels, n = np.array(labels, np.float64), len(labels)
    model.base = float((model.labels.sum() + 1) / (n + 2))
    if not n:
        return model
    there = (counts > 0).sum(0)
    # the root of a term's share, times its inverse document frequency; one word says less than a shape
    model.weight = (np.log((1 + n) / (1 + there)) + 0.1).astype(np.float32)
    model.weight[len(shapes) + 2 :] *= 0.1
    make = Vectors(model)
    x = make.weighted(counts).astype(np.float64)
    _, axes = np.linalg.eigh(x.T @ x)
    model.projection = axes[:, ::-1][:, :dims].astype(np.float32)
    model.vectors = make.latent(counts)
    return model


def score_texts(make: Vectors, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Scores from 0 to 1, and the similarity of the nearest neighbour.

    All voters vote that are as near as the last of the nearest ``neighbours``:
    of ties at the end none is left out.
    """
    m = make.model
    n = len(m.labels)
    if not n:
        return np.full(len(texts), m.base), np.zeros(len(texts))
    v = make.latent(make.counts(texts))
    # rounded, so that copies of one voter are ties
    cos = np.round(v @ m.vectors.T, 5)
    k = min(m.neighbours, n)
    last = np.partition(cos, n - k, axis=1)[:, n - k, None]
    row, near = np.nonzero(cos >= last)
    votes = np.exp(m.sharpness * (cos[row, near].astype(np.float64) - 1))
    score = np.bincount(row, votes * m.labels[near], len(texts)) / np.bincount(row, votes, len(texts))
    empty = ~v.any(1)
    score[empty] = m.base
    best = np.where(empty, 0.0, cos.max(1).astype(np.float64))
    return np.clip(score, 0, 1), best


def learn_quality(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 2500, dims: int = 48, neighbours: int = 15, sharpness: float = 8.0, n_words: int = 512, most_shapes: int = 256) -> QualityModel:
    """Fits a model on ``sample_docs`` at most of the labelled documents that satisfy ``may_learn``.

    Documents are chosen by a hash of their id. Of several labels of one the
    least counts, of several texts the one of the least digest; rows without id
    or label are left out. Terms are counted by the executors: what reaches the
    driver is the number of chosen documents with each of the ``most_shapes``
    most frequent shapes, and a row of term shares a document; the labelled
    vectors that are broadcast are as many.
    """
    spark = docs.sparkSession
    rows = labels.filter(may_learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    one = rows.groupBy(F.col(id_col).alias("id_")).agg(F.min(label_col).alias("label_"))
    chosen = [(r.id_, int(r.label_)) for r in bounded_rows(one, sample_docs, "id_").collect()]
    kind = dict(docs.dtypes)[id_col]
    picked = spark.createDataFrame(chosen, f"id_ {kind}, label_ int")
    texts = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id_")
    texts = texts.groupBy("id_", "label_").agg(F.min(F.struct(F.sha2("text", 256).alias("digest"), "text")).alias("least"))
    texts = stored(texts.select("label_", "least.digest", "least.text"), "labelled")

    seen = texts.select("text").mapInArrow(_shape_rows, "shape string, n long").groupBy("shape").agg(F.sum("n").alias("n"))
    shapes = [r.shape for r in seen.orderBy(F.desc("n"), "shape").limit(most_shapes).collect()]
    found = texts.mapInArrow(_count_rows(shapes, n_words), "label int, digest string, counts binary").collect()
    discard(texts)
    found.sort(key=lambda r: (r.digest, r.label))
    counts = np.array([np.frombuffer(r.counts, np.float32) for r in found]).reshape(len(found), unfitted(shapes, n_words).n_terms)
    return model_of_counts(shapes, counts, [r.label for r in found], dims, neighbours, sharpness, n_words)


def _shape_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = Counter(s for t in b.column(0) for s in shapes_in(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["shape", "n"])


def _count_rows(shapes: list[str], n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Vectors(unfitted(shapes, n_words))
        for b in batches:
            counts = [make.counts([t.as_py()]).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.binary())], names=["label", "digest", "counts"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", block: int = 256) -> DataFrame:
    """Scores every whole text by its text alone.

    Returns ``id_col, score double`` (0 to 1, higher: label 1 likelier) and
    ``nearest double`` (similarity of the nearest labelled text), one row per
    input row. A null, empty or blank text has the share of label 1 among the
    labelled as its score and 0 as ``nearest``. Other columns are not read.
    """
    texts_to_python(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Vectors(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                score, nearest = score_texts(make, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array(nearest, pa.float64())], names=["id", "score", "nearest"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(trimmed(run), f"id {kind}, score double, nearest double").withColumnRenamed("id", id_col)
