"""Pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, for the pipeline's stage.

Edited copies differ in far more than the two bits of op 3's fingerprints, so they are found by their shingles. Every
distinct text (ASCII case and spaces folded) gets BANDS keys of ROWS minima each; two texts of similarity 0.8 share no key
with a chance of (1 - 0.8^4)^32, one in 20 million, and more alike texts with less. Texts that share a key are then compared
exactly, by the shingles themselves, so a shared key alone never links. Keys under which the same texts stand are
compared once. Only texts that share a key are read again for their shingles, which travel once for each such key.

Within a key a text is compared with those that nothing links to it yet: a spanning forest of links results, never all
pairs. A key above CELL shingles is dealt out as pairs of chunks, so no key is bound to one task; its cost then grows with
the square of its texts, as far as they aren't similar.

Defined cases: a text of under five words has itself as its only shingle. Wordless texts and null ids take no part. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .simhash import _UPPER

WIDTH, BANDS, ROWS, SEED, CELL = 5, 32, 4, 42, 1 << 21
#: Similar if the shared shingles are at least LEAST of both sizes together: 4/9 for a Jaccard similarity of 0.8.
LEAST = (4, 9)
_ODD = np.random.default_rng(505).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = np.random.default_rng(550).integers(0, 2**64 - 1, BANDS * ROWS, dtype=np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_UPPER).split()


def content_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of WIDTH words in a row, sorted."""
    digest, join, n = xxhash.xxh64_intdigest, b" ".join, max(1, len(words) - WIDTH + 1)
    runs = zip(*(words[i:] for i in range(WIDTH)), strict=False) if n > 1 else [words]
    return np.unique(np.fromiter((digest(join(s), SEED) for s in runs), np.uint64, n))


def keys_of(h: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 1 << 11):  # a long text in slices: 1 kB a shingle
        least = np.minimum(least, ((h[at : at + (1 << 11), None] ^ _FLIP) * _ODD).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        ids, content, size, keys = [], [], [], []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = words_of(text)
            if doc_id is not None and words:
                h = shingles(words)
                ids.append(doc_id)
                content.append(content_of(words))
                size.append(len(h))
                keys.append(keys_of(h))
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), flat)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(content, pa.binary()), pa.array(size, pa.int64()), lists], ["id", "content", "size", "keys"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of id, text, and the content and cells that are asked of the id: cell, id and shingles."""
    for b in slices(batches):
        held, cells, ids, sets = 0, [], [], []
        for doc_id, text, content, wanted in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            words = words_of(text)
            if content_of(words) != content:
                continue
            h = shingles(words).view(np.int64)
            for cell in wanted:
                cells.append(cell)
                ids.append(doc_id)
                sets.append(h)
                held += len(h)
                if held >= 1 << 20:
                    yield _sets(cells, ids, sets)
                    held, cells, ids, sets = 0, [], [], []
        yield _sets(cells, ids, sets)


def _sets(cells: list[int], ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(h) for h in sets]).astype(np.int32)
    flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["cell", "id", "shingles"])


def similar(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the similar pairs, as index pairs into sets."""
    size = np.array([len(h) for h in sets], np.int64)
    ends = np.cumsum(size)
    distinct, back = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(back, kind="stable")]
    count = np.bincount(back, minlength=len(distinct))
    start = np.cumsum(count) - count
    free, a, b = np.ones(len(sets), bool), [], []
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed] = False
        todo = [seed]
        while todo and free.any():
            i = todo.pop()
            mine = back[ends[i] - size[i] : ends[i]]
            n = count[mine]
            at = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(holders[at], minlength=len(sets))
            found = np.flatnonzero(free & (LEAST[1] * shared >= LEAST[0] * (size + size[i]))).tolist()
            free[found] = False
            todo += found
            a += [i] * len(found)
            b += found
    return a, b


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of cell, id and shingles, sorted by cell: a < b of linked ids."""

    def links(ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(ids) > 1:
            a, b = (np.array(ids, np.int64)[np.array(x, np.int64)] for x in similar(sets))
            far = a != b
            if far.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[far]), pa.array(np.maximum(a, b)[far])], ["a", "b"])

    last, ids, sets = None, [], []
    for batch in batches:
        of = batch.column(2)
        flat, ends = of.values.to_numpy(), of.offsets.to_numpy()
        for k, (cell, doc_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if cell != last:
                yield from links(ids, sets)
                last, ids, sets = cell, [], []
            ids.append(doc_id)
            sets.append(flat[ends[k] : ends[k + 1]].copy())
    yield from links(ids, sets)


def pairs(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """a < b: ids of similar texts, a spanning forest for each key. Equal texts stand under their smallest id."""
    scratch = Scratch(docs.sparkSession, "copies")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = texts.mapInArrow(_prints, "id long, content binary, size long, keys array<long>")
    first = F.min_by(F.struct("size", "keys"), "id")
    classes = scratch.keep(prints.groupBy("content").agg(F.min("id").alias("id"), first.alias("x")).select("id", "content", "x.size", "x.keys"))
    rows = classes.select("id", "content", "size", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.bit_xor(F.xxhash64("id", "content")).alias("who")).where("n > 1")
    # The same texts under several keys: one of the keys is enough.
    once = scratch.keep(shared.groupBy("n", "all", "who").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("all") / F.lit(max(1, cell // 2))).cast("int").alias("chunks"), "all"))
    # Below the limit a key is one cell. Above it a row of chunk c meets every chunk: it goes to the cells {c, k} of all k.
    chunk = F.pmod(F.xxhash64("id", "content"), F.col("chunks")).cast("int")
    of = lambda k: F.xxhash64("key", F.least(chunk, k), F.greatest(chunk, k))
    cells = F.when(F.col("all") <= cell, F.array("key")).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), of))
    wanted = rows.join(once, "key").select("id", "content", F.explode(cells).alias("cell")).groupBy("id", "content").agg(F.collect_list("cell").alias("cells"))
    asked = texts.join(wanted, texts["doc_id"] == wanted["id"]).select("doc_id", "text", "content", "cells")
    sets = asked.mapInArrow(_fetch, "cell long, id long, shingles array<long>")
    return sets.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link, "a long, b long")
