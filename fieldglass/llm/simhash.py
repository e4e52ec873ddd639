"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

Every text gets a 64-bit fingerprint of its three-word shingles. Equal fingerprints are one class. Two fingerprints that
differ in at most RADIUS = 2 bits agree on at least two of four 16-bit quarters, so each fingerprint is filed under the
six pairs of quarters, and any link shows inside one of these bins. Within a bin the fingerprints, ordered by their
population count, are cut into tiles; a tile is compared with each later tile by exclusive-or and bit count, unless their
population counts differ beyond the radius. Bins are laid out one after the other, so a tile holds many small bins or a
part of a large one, and rows of different bins aren't linked. The comparison is exact: bins only say which tiles can meet.
A bin above BIN_LIMIT distinct fingerprints is dealt out as pairs of chunks, so no bin is bound to one task.

A tile run returns a spanning forest of its links, never all pairs. Links meet in a large-star / small-star contraction
over tables in the shared folder; nothing is collected.

Defined cases: null, empty and wordless texts have the fingerprint zero and link like any other. Rows that repeat an id
share its component; rows without an id link by their fingerprint, and have no component where no row with an id is
linked with them. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

RADIUS, TILE, BIN_LIMIT, SEED = 2, 64, 1 << 16, 42
#: Tile pairs compared at once.
AT_ONCE = 256
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | bytes | None) -> int:
    """64 bits, unsigned; a bit is set if it is set in over half of the shingles' XXH64."""
    raw = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").translate(_UPPER)
    words = raw.split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - 2)
    if n == 1:
        return digest(join(words), SEED)
    h = np.fromiter((digest(join(s), SEED) for s in zip(words, words[1:], words[2:], strict=False)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):  # a long text in slices: 64 bytes a shingle
        bits = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Union-find over the rows of one bin."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def tile_links(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE, bins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints of equal bin (all, if none are given), as index pairs into fps."""
    if not len(fps):
        return (np.zeros(0, np.int64),) * 2
    bins = np.zeros(len(fps), np.int64) if bins is None else bins
    order = np.lexsort((np.bitwise_count(fps), bins))
    n = -(-len(fps) // tile)
    x, own = np.zeros(n * tile, np.uint64), np.zeros(n * tile, np.int64)
    x[: len(fps)], own[: len(fps)] = fps[order], np.cumsum(np.r_[True, bins[order][1:] != bins[order][:-1]])
    own[len(fps) :] = -np.arange(n * tile - len(fps)) - 1  # rows of a bin each, to fill the last tile
    ones = np.bitwise_count(x).astype(np.int16)
    x, own, first, last = x.reshape(n, tile), own.reshape(n, tile), np.arange(n) * tile, np.minimum(np.arange(1, n + 1) * tile, len(fps)) - 1
    upper = np.triu(np.ones((tile, tile), bool), 1)
    forest, a, b = _Forest(len(fps)), [], []
    flat = own.ravel()
    left, step = np.arange(n), 0
    while len(left):
        for at in range(0, len(left), AT_ONCE):
            i = left[at : at + AT_ONCE]
            j = i + step
            near = (np.bitwise_count(x[i][:, :, None] ^ x[j][:, None, :]) <= radius) & (own[i][:, :, None] == own[j][:, None, :])
            if not step:
                near &= upper
            t, p, q = np.nonzero(near)
            for u, v in zip((i[t] * tile + p).tolist(), (j[t] * tile + q).tolist(), strict=True):
                if forest.join(u, v):
                    a.append(u)
                    b.append(v)
        step += 1
        left = left[left + step < n]
        # Tiles that share no bin have no link. In a bin rows are in order of population count, so if the last of one tile and
        # the first of another differ beyond the radius, all their rows do, and those of later tiles.
        left = left[(flat[last[left]] == flat[first[left + step]]) & (ones[first[left + step]] - ones[last[left]] <= radius)]
    return order[np.array(a, np.int64)], order[np.array(b, np.int64)]


_PAIRS = [sum(0xFFFF << 16 * q for q in pair) for pair in combinations(range(4), 2)]


def _bins(classes: DataFrame) -> DataFrame:
    """bin, fp, id: each fingerprint under its six pairs of quarters."""
    bins = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(_PAIRS)]
    return classes.select(F.explode(F.array(*bins)).alias("bin"), "fp", "id")


def _link_bins(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by bin; a bin that reaches over the end of a batch waits for the next. Rows: bin, fp, id."""

    def links(bins: np.ndarray, fps: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        # A row alone in its bin has no link.
        alone = np.r_[True, bins[1:] != bins[:-1]] & np.r_[bins[1:] != bins[:-1], True]
        bins, fps, ids = bins[~alone], fps[~alone], ids[~alone]
        i, j = (ids[k] for k in tile_links(fps, radius, bins=bins))
        far = i != j
        if far.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)[far]), pa.array(np.maximum(i, j)[far])], ["a", "b"])

    rest: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            x = [np.concatenate(p) for p in zip(rest, x, strict=True)]
        cut = int(np.flatnonzero(np.r_[True, x[0][1:] != x[0][:-1]])[-1])
        if cut:
            yield from links(x[0][:cut], x[1][:cut].view(np.uint64), x[2][:cut])
        rest = [c[cut:].copy() for c in x]
    if rest is not None:
        yield from links(rest[0], rest[1].view(np.uint64), rest[2])


def links(classes: DataFrame, radius: int = RADIUS, bin_limit: int = BIN_LIMIT) -> DataFrame:
    """a < b: ids of linked classes, a spanning forest for each bin. classes: fp, id, each distinct."""
    if radius > 2:
        raise ValueError("four quarters agree on two only up to a radius of 2")
    bins = _bins(classes)
    large = bins.groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") > bin_limit).select("bin", F.ceil(F.col("n") / (bin_limit // 2)).cast("int").alias("chunks"))
    dealt = bins.join(large, "bin", "left")
    # In a large bin a row of chunk c meets every chunk: it goes to the cells {c, k} of all k.
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cell = lambda k: F.xxhash64("bin", F.least(chunk, k), F.greatest(chunk, k))
    cells = F.when(F.col("chunks").isNull(), F.array("bin")).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), cell))
    rows = dealt.select(F.explode(cells).alias("bin"), "fp", "id")
    return rows.repartition("bin").sortWithinPartitions("bin").mapInArrow(lambda it: _link_bins(it, radius), "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of a < b edges. Large-star and small-star steps until
    every edge leads to its smallest node; each round is a table, each step an aggregate and a join on the node."""
    edges = scratch.keep(edges.distinct())
    state = None
    while True:
        # Large star: each larger neighbour (and, with it, the node) points at the smallest of the neighbourhood.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself point at the smallest.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        edges, old = scratch.keep(small), scratch.n
        scratch.drop(old - 1)  # the round before: nothing reads it any more
        got = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("b")).first()
        if tuple(got) == state and got[0] == got[2]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        state = tuple(got)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bin_limit: int = BIN_LIMIT) -> DataFrame:
    """doc_id, fp and component_id, one row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs))
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    # An id with several texts links their classes.
    several = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("_low"), F.max("fp").alias("_high")).where("_low <> _high").select("doc_id", "_low")
    same_id = prints.join(several, "doc_id").where("fp <> _low").select(F.col("_low").alias("a"), F.col("fp").alias("b"))
    # Classes are linked as fingerprints, so those that only rows without an id hold link others too.
    linked = components(links(classes.select("fp", F.col("fp").alias("id")), radius, bin_limit).unionByName(same_id), scratch)
    member = scratch.keep(linked.unionByName(linked.select(F.col("component").alias("node"), "component")).distinct())
    least = member.join(classes, member["node"] == classes["fp"]).groupBy("component").agg(F.min("id").alias("_least"))
    named = member.join(least, "component").select("node", "_least")
    known = classes.join(named, classes["fp"] == named["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("_least", "id").alias("component_id"))
    return prints.join(known, prints["fp"] == known["_fp"]).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
