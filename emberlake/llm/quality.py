"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are words (lower-cased, between blanks) and pairs of characters of three bytes
(scripts that set no blanks), by their hashes in ``VOCABULARY`` cells, and beside them
runs of three character classes (letters by case, digits, blanks, single marks); three
shares of repeated words, runs of three words and neighbours that are equal join them. On a sample of labelled
documents, ``SAMPLE`` of each label at most, chosen by a hash of doc_id, the terms are
weighted by inverse document frequency and reduced to ``DIMENSIONS`` by a truncated
singular value decomposition. The sample's vectors (a few MB, whatever the corpus) are
broadcast; every document's whole text is mapped to a vector, its cosines with all
of them computed in blocks, and the ``NEIGHBOURS`` nearest labels averaged with their
similarities as weights, times the number of labelled documents that a sampled one
stands for: a label that is cut to the sample keeps its share of the vote, so scores do
not move with the size of the table.

Only rows that are not held out (crc32 of doc_id as text, modulo 4, not 2) are learnt
from. Defined results: a text without any run (null, empty or under three bytes) has
score 0; with no labelled rows every other score is 0.5; labels of one doc_id are
averaged, a null one is ignored; a null doc_id is not held out and not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm import kernels as K
from emberlake.llm.shared import sliced, small_batches

SAMPLE = 2048
DIMENSIONS = 48
NEIGHBOURS = 15
THRESHOLD = 0.7
RUNS = 16**3
#: Cells of words and character pairs; 2**VOCABULARY_BITS.
VOCABULARY_BITS = 12
VOCABULARY = 1 << VOCABULARY_BITS
TERMS = RUNS + VOCABULARY
#: Documents whose cosines are computed at once.
ROWS = 256

_CLASS = np.full(256, 11, np.uint8)
_CLASS[0x00:0x20] = 15
_CLASS[0x7F] = 15
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|", "#*$%&")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[[ord(c) for c in "\"'()[]{}<>"]] = 13
_CLASS[[ord(c) for c in "-_"]] = 14
_CLASS[0x80:] = 12


def _repeats(word: np.ndarray) -> tuple[float, float, float]:
    n = len(word)
    if n < 4:
        return 0.0, 0.0, 0.0
    run = word[2:] * np.uint64(3) + word[1:-1] * np.uint64(5) + word[:-2] * np.uint64(7)
    return float(np.mean(word[1:] == word[:-1])), 1 - len(np.unique(word)) / n, 1 - len(np.unique(run)) / len(run)


def _pairs(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and cells of the pairs of three-byte characters."""
    lead = np.flatnonzero((d[:-5] & 0xF0 == 0xE0) & (d[3:-2] & 0xF0 == 0xE0)) if len(d) > 5 else np.zeros(0, np.int64)
    value = np.zeros(len(lead), np.uint64)
    for k in range(6):
        value = value << np.uint64(8) | d[lead + k]
    return lead, (K.mix(value) >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int64)


def features(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Term shares (rows x TERMS) and repetition shares (rows x 3), in blocks of rows."""
    data, offs = K.utf8(column)
    for lo, hi, d, o in K.blocks(data, offs):
        word, _, at = K.words(d, o, K.WORD_NOT_SPACE)
        kind = _CLASS[d].astype(np.int64)
        cell = (word >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int64)
        place, pair = _pairs(d)
        from_, to = np.searchsorted(place, o[:-1]), np.searchsorted(place, o[1:] - 5)  # a pair never crosses documents
        for a in range(0, hi - lo, ROWS):
            b = min(a + ROWS, hi - lo)
            terms, extra = np.zeros((b - a, TERMS), np.float32), np.zeros((b - a, 3), np.float32)
            for i in range(a, b):
                x = kind[o[i] : o[i + 1]]
                if len(x) >= 3:
                    terms[i - a, :RUNS] = np.bincount(x[:-2] * 256 + x[1:-1] * 16 + x[2:], minlength=RUNS) / (len(x) - 2)
                    said = np.concatenate([cell[at[i] : at[i + 1]], pair[from_[i] : max(from_[i], to[i])]])
                    terms[i - a, RUNS:] = np.bincount(said, minlength=VOCABULARY) / max(1, len(said))
                    extra[i - a] = _repeats(word[at[i] : at[i + 1]])
            yield terms, extra


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    counts: np.ndarray

    def latent(self, terms: np.ndarray, extra: np.ndarray) -> np.ndarray:
        z = _weighted(terms, extra, self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray, extra: np.ndarray) -> np.ndarray:
        blank = terms.sum(axis=1) == 0
        if not len(self.labels):
            return np.where(blank, 0.0, 0.5)
        cosine = self.latent(terms, extra) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) * self.counts[near]
        vote = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.where(blank, 0.0, np.clip(vote, 0.0, 1.0))


def _weighted(terms: np.ndarray, extra: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of the term matrix: runs and vocabulary each of length 1, and the repetitions."""
    v = np.empty((len(terms), TERMS + 3), np.float32)
    np.multiply(np.sqrt(terms), idf, out=v[:, :TERMS])
    for part in (v[:, :RUNS], v[:, RUNS:TERMS]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    np.sqrt(extra, out=v[:, TERMS:])
    return v


@dataclass
class Sample:
    """The term shares of sampled documents, kept sparse: ``at`` and ``share`` of row k lie between ``ends[k]`` and ``ends[k + 1]``."""

    at: np.ndarray
    share: np.ndarray
    ends: np.ndarray
    extra: np.ndarray

    def __len__(self) -> int:
        return len(self.extra)

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        """ROWS rows at a time, dense."""
        for lo in range(0, len(self), ROWS):
            hi = min(lo + ROWS, len(self))
            part = slice(self.ends[lo], self.ends[hi])
            dense = np.zeros((hi - lo, TERMS), np.float32)
            dense[np.repeat(np.arange(hi - lo), np.diff(self.ends[lo : hi + 1])), self.at[part]] = self.share[part]
            yield slice(lo, hi), dense


def train(sample: Sample, labels: np.ndarray, counts: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """Truncated decomposition by subspace iteration from a seeded start; ``counts``: how many documents each row stands for.

    No more than ROWS rows are dense at any time.
    """
    idf = (np.log((1 + len(labels)) / (1 + np.bincount(sample.at, minlength=TERMS))) + 1).astype(np.float32)
    if not len(labels):
        return Model(idf, np.zeros((TERMS + 3, 1), np.float32), np.zeros((0, 1), np.float32), labels, counts)
    used = np.zeros(TERMS + 3, bool)
    used[sample.at] = True
    used[TERMS:] = sample.extra.any(axis=0)
    dims = max(1, min(dimensions, np.count_nonzero(used), len(labels)))
    q = np.zeros((TERMS + 3, dims), np.float32)
    q[used] = np.linalg.qr(np.random.default_rng(7).standard_normal((np.count_nonzero(used), dims)))[0]
    for _ in range(8):
        turned = np.zeros_like(q)
        for rows, dense in sample.blocks():
            part = _weighted(dense, sample.extra[rows], idf)
            turned += part.T @ (part @ q)
        q[used] = np.linalg.qr(turned[used])[0]
    model = Model(idf, q, np.zeros((0, dims), np.float32), labels.astype(np.float64), counts)
    model.vectors = np.concatenate([model.latent(dense, sample.extra[rows]) for rows, dense in sample.blocks()])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample: ``sample`` labelled documents of each label at most."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("_id")).distinct(), "_id", "left_semi")
    totals = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}  # two rows
    by_hash = [F.xxhash64("_id", F.lit(1)), F.col("_id")]
    chosen = known.where("_label = 1").orderBy(*by_hash).limit(sample).union(known.where("_label = 0").orderBy(*by_hash).limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id").select("_id", "_label", "text")  # 2 * sample rows
    kind = "_id long, _label int, at binary, share binary, extra binary"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lo = 0
            for terms, extra in features(batch.column(2)):
                at = [np.flatnonzero(x) for x in terms]
                part = batch.slice(lo, len(terms))
                lo += len(terms)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.astype("<u2").tobytes() for x in at], pa.binary()), pa.array([t[x].tobytes() for t, x in zip(terms, at, strict=True)], pa.binary()), pa.array([x.tobytes() for x in extra], pa.binary())], names=["_id", "_label", "at", "share", "extra"])

    with small_batches(docs.sparkSession):
        got = rows.mapInArrow(extract, kind).dropDuplicates(["_id"]).toArrow().sort_by("_id")  # 2 * sample rows of 6 bytes a term
    flat = lambda name, of: np.frombuffer(b"".join(got[name].to_pylist()), of)
    sizes = np.array([len(x) // 2 for x in got["at"].to_pylist()], np.int64)
    chosen_ = Sample(flat("at", "<u2"), flat("share", np.float32), np.concatenate([[0], np.cumsum(sizes)]), flat("extra", np.float32).reshape(len(got), 3))
    label = got["_label"].to_numpy().astype(np.int64)
    del got
    stands_for = np.array([totals.get(x, 0) / max(1, np.count_nonzero(label == x)) for x in (0, 1)])
    return train(chosen_, label.astype(np.float64), stands_for[label])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and text_hash of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lo = 0
            for terms, extra in features(batch.column(2)):
                part = batch.slice(lo, len(terms))
                lo += len(terms)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.score(terms, extra), pa.float64())], names=["doc_id", "text_hash", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents that the classifier does not reject, in one pass over them."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            good = [model.value.score(t, x) >= threshold for t, x in features(batch.column(at))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
