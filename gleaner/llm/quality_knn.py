"""Quality classification by nearest-neighbour voting among latent-semantic vectors.

A document's terms are its words, their shapes and bands of a few whole-text statistics (length, repetition, share of
capitals and symbols), hashed into `TERMS` cells. Counts are damped, weighted by the inverse document frequency over
all documents, and projected on the leading singular vectors of the labelled sample. The labelled vectors, at most
`SAMPLE_PER_LABEL` for each label, are broadcast; every document's cosines with all of them are computed exactly, in
blocks, and the `NEIGHBOURS` nearest vote with a weight that grows with their similarity.

The sample's bound is a parameter; the document frequencies cover all documents. Its size bounds what is broadcast:
TERMS x DIMENSIONS weights and 2 x SAMPLE_PER_LABEL vectors.

Defined results: null texts are empty; empty texts have their own terms (the bands) and are scored like any other;
without labelled rows the score is 0.5. Labelled rows without a document, null labels and null ids are not learned
from; of a document with several labels each counts. Repeated rows get the same score, up to the rounding of sums.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_binary

TERMS = 4096
DIMENSIONS = 64
SAMPLE_PER_LABEL = 1500
#: Hashes are counted in 2 ** RANGE_BITS ranges a label.
RANGE_BITS = 12
ROUNDS = 6
NEIGHBOURS = 15
SHARPNESS = 8.0
CUT = 0.7
CACHED_WORDS = 300_000
BAND_WEIGHT = 24

TOKEN = re.compile(r"\S+")
SHAPE = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^\x00-\x7f]+|[^A-Za-z0-9]+")


def cell(term: str) -> int:
    return crc32(term.encode("utf-8", "replace")) % TERMS


def shape(word: str) -> str:
    """The word's runs of kinds of characters: A, a, 9, x (not ASCII), or the first symbol of a run."""

    def kind(run: str) -> str:
        c = run[0]
        return "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "9" if c.isdigit() else "x" if c > "\x7f" else c

    return "".join(kind(run) for run in SHAPE.findall(word))


def bands(text: str, words: list[str]) -> list[str]:
    """Statistics of the whole text in coarse bands, as terms."""
    n, chars = len(words), max(1, len(text))
    distinct = len(set(words)) / n if n else 0
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n if n else 0
    lines = [x for x in text.split("\n") if x]
    same_lines = 1 - len(set(lines)) / len(lines) if lines else 0
    upper = sum(map(str.isupper, words)) / n if n else 0
    symbol = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / n if n else 0
    size = chars / n if n else 0
    share = {"d": distinct, "r": repeats, "l": same_lines, "u": upper, "s": symbol}
    out = [f"n{min(12, int(n).bit_length())}", f"w{min(20, int(size)) // 3}"]
    return [f"band:{x}" for x in [*out, *(f"{k}{int(v * 5 + 0.5)}" for k, v in share.items())]]


class Terms:
    """Counts of hashed terms. Cells of a bounded number of words are kept."""

    def __init__(self):
        self.cells: dict[str, int] = {}  # the word's cell x TERMS + its shape's

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct cells and their counts."""
        words = TOKEN.findall(text)
        cells = self.cells
        if len(cells) > CACHED_WORDS:
            cells.clear()
        for w in set(words).difference(cells):
            cells[w] = cell("w:" + w.lower()) * TERMS + cell("s:" + shape(w))
        both = np.fromiter(map(cells.__getitem__, words), np.int64, len(words))
        own = np.repeat(np.array([cell(b) for b in bands(text, words)], np.int64), BAND_WEIGHT)
        n = np.bincount(np.r_[both // TERMS, both % TERMS, own], minlength=TERMS)
        found = np.flatnonzero(n)
        return found, n[found]


@dataclass
class Model:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _weights(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), TERMS), np.float32)
    for i, (cells, n) in enumerate(rows):
        out[i, cells] = (1 + np.log(n)) * idf[cells]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(sample: list[tuple[str, int]], idf: np.ndarray) -> Model | None:
    """sample: (text, label). The leading singular vectors of its weighted terms, and its own vectors among them."""
    if not sample:
        return None
    terms = Terms()
    weighted = _weights([terms.counts(text) for text, _ in sample], idf).astype(np.float64)
    # Subspace iteration for the leading right singular vectors; a full decomposition would take a minute.
    rng = np.random.default_rng(0)
    basis = np.linalg.qr(weighted.T @ (weighted @ rng.normal(size=(TERMS, DIMENSIONS + 16))))[0]
    for _ in range(ROUNDS):
        basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
    small = weighted @ basis
    values, turn = np.linalg.eigh(small.T @ small)
    top = np.argsort(values)[::-1][:DIMENSIONS]
    projection = (basis @ turn[:, top[values[top] > 1e-9]]).astype(np.float32)
    return Model(idf, projection, _unit(weighted.astype(np.float32) @ projection), np.array([y for _, y in sample], float))


def votes(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, each weighted by exp(SHARPNESS x (cosine - 1))."""
    vectors = _unit(_weights(rows, model.idf) @ model.projection)
    cosine = vectors @ model.vectors.T
    k = min(NEIGHBOURS, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.exp(SHARPNESS * (np.take_along_axis(cosine, near, 1).astype(float) - 1))
    prior = 1e-3 * 0.5
    return np.clip(((weight * model.labels[near]).sum(axis=1) + prior) / (weight.sum(axis=1) + 1e-3), 0, 1)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and of those that have each cell, over all rows. Each task sends one row for each
    cell that it has seen, so at most TERMS reach the driver after the aggregation."""

    def count(batches):
        terms, seen, n = Terms(), np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for raw in as_binary(batch.column(0)):
                seen[terms.counts(raw.decode("utf-8", "replace") if raw else "")[0]] += 1
                n += 1
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, own]), pa.array(np.r_[n, seen[own]])], ["cell", "n"])

    sums = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out, total = np.zeros(TERMS, np.int64), 0
    for r in sums.collect():
        if r.cell < 0:
            total = r.n
        else:
            out[r.cell] = r.n
    return total, out


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> list[tuple[str, int]]:
    """At most per_label documents of each label, the first by a hash of the id. The ids are chosen before any text
    is read, so the join has a bounded side. A histogram of the hashes tells which of their ranges hold the first
    per_label rows, so that only about as many are sorted in one task, however many labels there are."""
    known = labels.where("doc_id is not null and quality is not null").select(
        "doc_id", F.col("quality").cast("int").alias("y"), F.xxhash64("doc_id").alias("h")
    )
    ranged = known.withColumn("range", F.shiftright("h", 64 - RANGE_BITS))
    before = F.sum("n").over(W.partitionBy("y").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sizes = ranged.groupBy("y", "range").agg(F.count("*").alias("n"))
    first = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < per_label).select("y", "range")
    order = W.partitionBy("y").orderBy("h", "doc_id")
    near = ranged.join(F.broadcast(first), ["y", "range"])
    chosen = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_label).select("doc_id", "y")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return sorted((r.text, r.y) for r in texts.join(F.broadcast(chosen), "doc_id").select("text", "y").toLocalIterator())


_workers: dict[str, tuple[Model, Terms]] = {}
ROWS_AT_ONCE = 128


def quality_scores(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """doc_id, score (share of label 1) of each row of docs; labels: the rows to learn from (doc_id, quality)."""
    total, having = document_frequencies(docs)
    idf = (np.log((1 + total) / (1 + having)) + 0.1).astype(np.float32)
    model = fit(training_sample(docs, labels, per_label), idf)
    own = docs.select("doc_id", "text")
    if model is None:
        return own.select("doc_id", F.lit(0.5).alias("score"))
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @arrow_udf("double")
    def vote(text: pa.Array) -> pa.Array:
        if key not in _workers:  # a worker keeps one model
            _workers.clear()
            _workers[key] = sent.value, Terms()
        fitted, terms = _workers[key]
        cells = as_binary(text)
        out = [np.empty(0)]
        for at in range(0, len(cells), ROWS_AT_ONCE):
            rows = [terms.counts(raw.decode("utf-8", "replace") if raw else "") for raw in cells[at : at + ROWS_AT_ONCE]]
            out.append(votes(fitted, rows))
        return pa.array(np.concatenate(out), pa.float64())

    return own.select("doc_id", vote.asNondeterministic()(F.col("text")).alias("score"))
