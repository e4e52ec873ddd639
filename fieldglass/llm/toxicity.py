"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words in lower case without ASCII signs, each once, hashed into 2^18 buckets. The score is a
logistic of a constant, a weight for each bucket present, and for each pair of buckets the inner product of their learned
vectors: pairs such as an insult with a group's name count beyond the sum of their weights. The pair sum is computed in
linear time as half of (squared sum minus sum of squares).

Only buckets whose presence depends on the label in the sample (likelihood-ratio statistic above MIN_G2) have weights;
all others are zero, so long clean texts don't gather noise. The machine is fitted on the driver, on the hashed terms of
at most SAMPLE labelled documents of at most LONGEST bytes; whole texts are scored.

Defined cases: null and empty texts have no term and score the constant. With no labels, or only one kind, the score is
the share of toxic labels (0 without any). Repeated rows score alike. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, held_out, table
from .labelled import sample

SAMPLE, LONGEST, BITS, FACTORS, EPOCHS, SEED, MIN_G2 = 8000, 262_144, 18, 8, 30, 11, 11.0
THRESHOLD = 0.5
CACHED = 400_000
_PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))


def terms(raw: bytes) -> set[bytes]:
    return set(raw.translate(_PLAIN).split())


def bucket(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) & ((1 << BITS) - 1)


@dataclass
class Machine:
    constant: float
    buckets: np.ndarray  # sorted
    weights: np.ndarray  # of each
    factors: np.ndarray  # of each, x FACTORS

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: positions in ``buckets``, of each text."""
        z = np.full(len(rows), self.constant)
        for i, at in enumerate(rows):
            if len(at):
                v = self.factors[at]
                z[i] += self.weights[at].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def g2(held: np.ndarray, y: np.ndarray, buckets: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic of presence against label for each bucket."""
    n, pos = len(y), y.sum()
    have = np.bincount(held, minlength=len(buckets)).astype(float)
    have_pos = np.bincount(held, y[row], len(buckets))
    cells = [(have_pos, have * pos / n), (have - have_pos, have * (n - pos) / n), (pos - have_pos, (n - have) * pos / n), (n - pos - have + have_pos, (n - have) * (n - pos) / n)]
    return 2 * sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0) for o, e in cells)


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """AdaGrad on the log loss, positive rows weighted so that both labels count alike up to a factor of 8."""
    none = np.zeros(0)
    share = float(y.mean()) if len(y) else 0.0
    logit = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if not len(y) or share in (0.0, 1.0):
        return Machine(logit, none.astype(np.int64), none, np.zeros((0, FACTORS)))
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    buckets, held = np.unique(np.concatenate(rows), return_inverse=True)
    keep = np.flatnonzero(g2(held, y, buckets, row) >= MIN_G2)
    place = np.full(len(buckets), -1)
    place[keep] = np.arange(len(keep))
    kept = place[held] >= 0
    row, held = row[kept], place[held][kept]
    ends = np.searchsorted(row, np.arange(len(rows) + 1))
    rng = np.random.default_rng(seed)
    w, v, c = np.zeros(len(keep)), rng.normal(0, 0.05, (len(keep), FACTORS)), np.array([logit])
    sw, sv, sc = np.full(w.shape, 1e-6), np.full(v.shape, 1e-6), np.full(1, 1e-6)
    weight = np.where(y > 0, min(8.0, (1 - share) / share), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            cols = [held[ends[i] : ends[i + 1]] for i in some]
            of = np.repeat(np.arange(len(some)), [len(x) for x in cols])
            ids = np.concatenate(cols)
            vx = v[ids]
            sums = np.zeros((len(some), FACTORS))
            np.add.at(sums, of, vx)
            squares = np.bincount(of, (vx**2).sum(axis=1), len(some))
            z = c[0] + np.bincount(of, w[ids], len(some)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            dz = weight[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            gw = np.bincount(ids, dz[of], len(w)) + 1e-5 * w
            gv = np.zeros_like(v)
            np.add.at(gv, ids, dz[of, None] * (sums[of] - vx))
            gv += 1e-4 * v
            for x, g, s, rate in ((w, gw, sw, 0.2), (v, gv, sv, 0.05), (c, dz.sum(keepdims=True), sc, 0.1)):
                s += g * g
                x -= rate * g / np.sqrt(s)
    return Machine(float(c[0]), buckets[keep], w, v)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, y and the distinct buckets of each whole text of a labelled sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({bucket(t) for t in terms(x or b"")}) for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), b.column(2)], ["doc_id", "buckets", "y"])

    return docs.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, buckets array<int>, y int")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE, longest: int = LONGEST) -> Machine:
    got = sorted(hashed(sample(docs, labels, label, rows, longest)).collect(), key=lambda r: r.doc_id)
    return fit([np.array(r.buckets, np.int64) for r in got], np.array([r.y for r in got], float))


def classify(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each row of docs."""
    shared = Shared(docs.sparkSession, machine)  # at most 2^18 buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {b: i for i, b in enumerate(m.buckets.tolist())}
        known: dict[bytes, int] = {}
        for b in batches:
            rows = []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                at = set()
                for t in terms(raw or b""):
                    i = known.get(t)
                    if i is None:
                        if len(known) >= CACHED:
                            known.clear()
                        i = known[t] = place.get(bucket(t), -1)
                    if i >= 0:
                        at.add(i)
                rows.append(np.array(sorted(at), np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(rows))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
