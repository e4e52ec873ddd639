"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector. Learned filters of 16 bytes step over the text by 8, so neighbours overlap by half; 16
such steps make a chunk of 136 bytes, and chunks overlap and cover the whole text. A filter's largest response in a chunk
is pooled twice: its maximum over all chunks, and its mean. Both, and the logarithm of the number of chunks, combine into
one probability. Texts are scored whole, in blocks of bounded size, however long they are.

The network is fitted on the driver, on at most SAMPLE labelled documents of at most LONGEST bytes (a documented bound),
by Adam with a fixed seed and number of steps.

Defined cases: null and empty texts are scored as one empty chunk. With no labels, or only one kind, the score is 1.0
or the share of good labels (0.5 without any). Repeated rows score alike. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, held_out, table
from .labelled import sample

SAMPLE, LONGEST, STEPS, BATCH, SEED = 2500, 32_768, 500, 32, 5
DIM, FILTERS, BLOCK, PER_CHUNK = 8, 24, 8, 16
THRESHOLD = 0.3
#: Blocks scored at once: 2 MB of text.
AT_ONCE = 1 << 18


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # BLOCK * DIM x 2 * FILTERS: first half of the filter, then the second
    bias: np.ndarray  # FILTERS
    head: np.ndarray  # 2 * FILTERS + 2: of the maxima, the means, the length, and the constant

    @classmethod
    def start(cls, rng: np.random.Generator) -> Network:
        f = rng.normal(0, 1 / np.sqrt(BLOCK * DIM), (BLOCK * DIM, 2 * FILTERS))
        return cls(*(x.astype(np.float32) for x in (rng.normal(0, 0.7, (256, DIM)), f, np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS + 2))))


def _blocks(raw: bytes) -> int:
    """Blocks of a text, padded: two at least, so that there is a filter position."""
    return max(2, -(-len(raw) // BLOCK))


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([_blocks(t) for t in texts], np.int64)
    flat = b"".join(t.ljust(k * BLOCK, b"\0") for t, k in zip(texts, n.tolist(), strict=True))
    return np.frombuffer(flat, np.uint8), n


def _chunks(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks start, in blocks, and how many each text has. A text of n blocks has n - 1 filter positions; the
    last position of the array of blocks belongs to no text's chunk but stands at its end, and is masked."""
    per = np.maximum(1, -(-(n - 1) // PER_CHUNK))
    first = np.cumsum(n) - n
    starts = np.repeat(first - (np.cumsum(per) - per) * PER_CHUNK, per) + np.arange(per.sum()) * PER_CHUNK
    return starts, per


def _forward(net: Network, flat: np.ndarray, n: np.ndarray):
    x = net.embed[flat].reshape(-1, BLOCK * DIM)
    both = x @ net.filters
    out = both[:, :FILTERS]
    out[:-1] += both[1:, FILTERS:]
    out += net.bias
    out[np.cumsum(n) - 1] = -np.inf  # a filter position doesn't reach over the end of a text
    starts, per = _chunks(n)
    top = np.maximum.reduceat(out, starts, axis=0)
    return x, out, starts, per, top


def _pool(top: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held = np.maximum(top, 0)
    at = np.cumsum(per) - per
    return np.maximum.reduceat(held, at, axis=0), np.add.reduceat(held, at, axis=0)


def _features(most: np.ndarray, total: np.ndarray, per: np.ndarray) -> np.ndarray:
    return np.concatenate([most, total / per[:, None], np.log(per)[:, None] / 4, np.ones((len(per), 1))], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradients(net: Network, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    flat, n = _pack(texts)
    x, out, starts, per, top = _forward(net, flat, n)
    most, total = _pool(top, per)
    feats = _features(most, total, per)
    dz = (_sigmoid(feats @ net.head) - y) / len(y)
    d_most, d_mean = dz[:, None] * net.head[:FILTERS], dz[:, None] * net.head[FILTERS : 2 * FILTERS] / per[:, None]
    of = np.repeat(np.arange(len(per)), per)
    d_top = (d_mean[of] + d_most[of] * (top == most[of])) * (top > 0)
    size = np.diff(np.r_[starts, len(out)])
    d_out = np.repeat(d_top, size, axis=0) * (out == np.repeat(top, size, axis=0))
    d_both = np.zeros((len(out), 2 * FILTERS), np.float32)
    d_both[:, :FILTERS] = d_out
    d_both[1:, FILTERS:] = d_out[:-1]
    d_x = (d_both @ net.filters.T).reshape(-1, DIM)
    d_embed = np.stack([np.bincount(flat, d_x[:, k], 256) for k in range(DIM)], axis=1)
    return [d_embed, x.T @ d_both, d_out.sum(axis=0), feats.T @ dz]


def fit(texts: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> Network:
    """Adam on the log loss; every text is seen equally often, in an order drawn from the seed."""
    rng = np.random.default_rng(seed)
    net = Network.start(rng)
    weights = [net.embed, net.filters, net.bias, net.head]
    if not len(y) or y.min() == y.max():
        net.head[:] = 0
        p = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        net.head[-1] = np.log(p / (1 - p))
        return net
    net.head[-1] = np.log(y.mean() / (1 - y.mean()))
    m, v = [np.zeros(w.shape) for w in weights], [np.zeros(w.shape) for w in weights]
    queue: list[int] = []
    for t in range(1, steps + 1):
        while len(queue) < batch:
            queue += rng.permutation(len(texts)).tolist()
        at, queue = queue[:batch], queue[batch:]
        rate = 0.01 * min(1, t / 20) * (1 - 0.95 * t / steps)
        for w, g, a, b, decay in zip(weights, _gradients(net, [texts[i] for i in at], y[at]), m, v, (1e-4, 1e-4, 0, 1e-4), strict=True):
            g = g + decay * w
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def score(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probabilities. Texts are packed into blocks of bounded size; a longer text is cut at chunk ends, with the overlap,
    and its pools are merged, which changes nothing."""
    piece = AT_ONCE // PER_CHUNK * PER_CHUNK * BLOCK  # bytes, a whole number of chunks
    most = np.zeros((len(texts), FILTERS))
    total, per = np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
    pack: list[bytes] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal pack, owner, held
        if pack:
            flat, n = _pack(pack)
            _, _, _, chunks, top = _forward(net, flat, n)
            a, b = _pool(top, chunks)
            np.maximum.at(most, owner, a)
            np.add.at(total, owner, b)
            np.add.at(per, owner, chunks)
        pack, owner, held = [], [], 0

    for i, t in enumerate(texts):
        at = 0
        while True:
            # A piece ends one block after its last chunk's last position starts; the next begins with that block.
            last = len(t) - at <= piece + BLOCK
            part = t[at:] if last else t[at : at + piece + BLOCK]
            if held and held + len(part) > piece:
                flush()
            pack.append(part)
            owner.append(i)
            held += len(part)
            at += piece
            if last:
                break
    flush()
    return _sigmoid(_features(most, total, np.maximum(per, 1)) @ net.head)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE, longest: int = LONGEST) -> Network:
    got = sorted(sample(docs, labels, label, rows, longest).collect(), key=lambda r: r.doc_id)
    return fit([r.text.encode() for r in got], np.array([r.y for r in got], float))


def classify(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each row of docs."""
    weights = Shared(docs.sparkSession, net)  # some tens of kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = weights.value
        for b in batches:
            p = score(net, [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
