"""Suffix-array dedup: removes bytes covered by a repeated 100-byte string, keeping each string's first occurrence.

A suffix array of a whole corpus doesn't fit anywhere, so the work is cut into small collections that between them hold
every repeat of LENGTH bytes:

1. Anchors. Every window of LENGTH bytes has an anchor: its 32-byte gram with the smallest hash. The choice depends only on
   the window's bytes, so equal windows have equal anchors, wherever they stand. About one position in 35 is an anchor.
   With an anchor goes a hash of its whole context: all bytes that a window with this anchor can reach, 68 to the left
   and 100 to the right, as far as the text goes.
2. Equal contexts. Anchors are dealt by gram hash. Of equal contexts all but the first are covered outright; most copied
   text ends here. Batches do this first for themselves, so a passage in a third of all texts is one row a batch.
3. Different contexts of one gram, that is, the ends of copied passages. Only their bytes are fetched. The collection of
   all contexts of a gram gets an enhanced suffix array; a stack scan of its common-prefix intervals, with the test for
   different bytes to the left, gives maximal repeats with all occurrences. All but the first occurrence are covered.
   Of a context only what reaches from the first to the last window that stands more than once in its collection enters the
   array, most of what differs stays out. A gram with over HOT different contexts is dealt out by its sides first: two contexts
   of a gram hold a common window only if they agree on the SIDE = 34 bytes before the gram, or on the 34 after it, as a
   window has that many on one of its sides. Of sides with over HOT contexts still, each window is dealt by its own hash.
4. Covered intervals meet their text, which is cut.

Order is by (doc_id, start) throughout. Equality in steps 2 and for HOT grams is by 128 bits of hash, in step 3 by bytes.

Defined cases: null texts count as empty; texts under LENGTH bytes have no window and stay whole. A null id takes no part
and stays whole. Rows that repeat an id count as one document standing there once: all get the same cuts. An empty
table gives an empty result; extra columns are ignored. Cutting bytes can split a character: ``cut`` drops its rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_shuffles, parts, slices, table
from .suffix_array import SuffixArray

LENGTH, GRAM, HOT = 100, 32, 20_000
#: Window starts in a segment of the anchor scan, and bytes of contexts under one suffix array.
SEGMENT, COLLECTION = 1 << 17, 1 << 18
_REACH = LENGTH - GRAM  # how far an anchor can stand from the start of its window
SIDE = _REACH // 2
#: kind: an anchor of a context (to be matched), a covered interval, a context whose bytes are wanted.
ANCHOR, COVERED, WANTED = 0, 1, 2
_TABLE = np.random.default_rng(2024).integers(1, 2**64, 256, dtype=np.uint64)
_ODD = np.random.default_rng(4202).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SCHEMA = "kind byte, h long, hc long, doc long, a long, b long"
_ARROW = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("hc", pa.int64()), ("doc", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _grams(flat: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 32 bytes from each position: five doublings, each with multipliers of its own."""
    x, size = _TABLE[flat], 1
    for i in range(5):
        x = x[:-size] * _ODD[2 * i] + x[size:] * _ODD[2 * i + 1]
        x ^= x >> np.uint64(31)
        size *= 2
    return x


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _scan(pieces: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    """Anchors of pieces of texts: (document, offset of the piece, where its windows start, bytes). A piece holds
    2 * LENGTH bytes beyond its windows on either side, where the text has them; windows start in a SEGMENT."""
    flat = np.frombuffer(b"".join(p[3] for p in pieces) + b"\0" * (2 * LENGTH), np.uint8)
    sizes = np.array([len(p[3]) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    grams = _grams(flat)
    key = (_scramble(grams) & ~np.uint64((1 << 22) - 1)) | np.arange(len(grams), dtype=np.uint64)
    least = _window_min(key, _REACH + 1)[: ends[-1]]
    place = np.arange(ends[-1])
    low, high = np.array([p[2] for p in pieces], np.int64) + ends - sizes, ends - LENGTH
    valid = (place >= np.repeat(low, sizes)) & (place <= np.repeat(np.minimum(high, low + SEGMENT - 1), sizes))
    least = least[valid]
    least = least[np.r_[True, least[1:] != least[:-1]]]
    at = np.unique(least & np.uint64((1 << 22) - 1)).astype(np.int64)
    of = np.searchsorted(ends, at, side="right")
    begin = ends[of] - sizes[of]
    low, high = np.maximum(begin, at - _REACH), np.minimum(ends[of], at + LENGTH)
    # The context as six grams that overlap or touch, and its two extents.
    hc = (at - low).astype(np.uint64) * np.uint64(1 << 8) + (high - at).astype(np.uint64)
    for i, step in enumerate((at - _REACH, at - _REACH + 32, at - 4, at + 28, at + 60, at + LENGTH - GRAM)):
        hc = _scramble(hc * _ODD[10] + grams[np.clip(step, low, high - GRAM)] * _ODD[11] + np.uint64(i))
    doc, offset = np.array([p[0] for p in pieces], np.int64)[of], np.array([p[1] for p in pieces], np.int64)[of]
    place = at - begin + offset
    return [_scramble(grams[at] * _ODD[12]).view(np.int64), hc.view(np.int64), doc, place, (place - (at - low)), place + (high - at)]


def anchors(ids: list[int | None], texts: list[bytes]) -> list[np.ndarray]:
    """h, hc, doc, place of the anchor, and its context's start and end, of whole texts."""
    found: list[list[np.ndarray]] = []
    pieces: list[tuple[int, int, int, bytes]] = []
    held, margin = 0, 2 * LENGTH
    for doc, raw in zip(ids, texts, strict=True):
        if doc is None or len(raw) < LENGTH:
            continue
        for at in range(0, len(raw) - LENGTH + 1, SEGMENT):
            low, high = max(0, at - margin), min(len(raw), at + SEGMENT + margin)
            pieces.append((doc, low, at - low, raw[low:high]))
            held += high - low
            if held >= SEGMENT:
                found.append(_scan(pieces))
                pieces, held = [], 0
    if pieces:
        found.append(_scan(pieces))
    if not found:
        return [np.zeros(0, np.int64)] * 6
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _merge(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of touching intervals of each document."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    new_doc = np.r_[True, doc[1:] != doc[:-1]]
    group = np.cumsum(new_doc)
    # A running maximum of ends within each document: documents are lifted apart.
    lift = group * (np.int64(b.max()) + 1)
    reach = np.maximum.accumulate(b + lift) - lift
    start = new_doc | np.r_[True, a[1:] > reach[:-1]]
    first = np.flatnonzero(start)
    return doc[first], a[first], np.maximum.reduceat(reach, first)


def _batch(kind: int, h=None, hc=None, doc=None, a=None, b=None) -> pa.RecordBatch:
    n = len(doc)
    col = lambda x: pa.array(np.zeros(n, np.int64) if x is None else x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), col(h), col(hc), col(doc), col(a), col(b)], schema=_ARROW)


def _covered(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    doc, a, b = _merge(doc, a, b)
    # Covered intervals need no match: they are spread evenly over the tasks.
    return _batch(COVERED, h=_scramble((doc * 31 + a).astype(np.uint64)).view(np.int64), doc=doc, a=a, b=b)


#: An anchor's row: a is place * 2^16 + bytes to the left of it * 2^8 + bytes to the right, all within its context.
def _packed(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (place << 16) | ((place - low) << 8) | (high - place)


def _span(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = a >> 16
    return place - ((a >> 8) & 255), place + (a & 255)


def _combine(h: np.ndarray, hc: np.ndarray, doc: np.ndarray, a: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The first of each (h, hc) as an anchor; the others as covered intervals."""
    order = np.lexsort((a, doc, hc, h))
    h, hc, doc, a = h[order], hc[order], doc[order], a[order]
    same = np.r_[False, (h[1:] == h[:-1]) & (hc[1:] == hc[:-1])]
    twice = np.r_[False, same[1:] & (doc[1:] == doc[:-1]) & (a[1:] == a[:-1])]
    later = same & ~twice
    # A row whose equals are the first itself isn't covered, however often it comes.
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    later &= ~((doc == doc[head]) & (a == a[head]))
    if later.any():
        yield _covered(doc[later], *_span(a[later]))
    yield _batch(ANCHOR, h[~same], hc[~same], doc[~same], a[~same])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, hc, doc, place, low, high = anchors(b.column(0).to_pylist(), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
        if len(h):
            yield from _combine(h, hc, doc, _packed(place, low, high))


def _resolve(batches: Iterator[pa.RecordBatch], want: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, hc, doc, a). Passes covered intervals on, adds those of equal contexts, and, if ``want``, asks for
    the bytes of the first of each context of a gram that has several. Holds one row over from batch to batch."""
    carry: tuple | None = None  # h and the last hc, doc and a of its first; doc, a and hc of the group's first; asked
    for batch in batches:
        kind, h, hc, doc, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        done = kind == COVERED
        if done.any():
            yield _batch(COVERED, doc=doc[done], a=a[done], b=b[done])
        at = np.flatnonzero(kind == ANCHOR)
        if not len(at):
            continue
        h, hc, doc, a = h[at], hc[at], doc[at], a[at]
        asked = False
        if carry:  # two rows stand for what came before: the first of the group, and the first of its last context
            h, hc = np.r_[carry[0], carry[0], h], np.r_[carry[6], carry[1], hc]
            doc, a = np.r_[carry[4], carry[2], doc], np.r_[carry[5], carry[3], a]
            asked = carry[7]
        old = 2 if carry else 0
        same_h = np.r_[False, h[1:] == h[:-1]]
        same = same_h & np.r_[False, hc[1:] == hc[:-1]]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        later = same & ~((doc == doc[head]) & (a == a[head]))
        later[:old] = False
        if later.any():
            yield _covered(doc[later], *_span(a[later]))
        group = np.cumsum(~same_h) - 1
        first = np.flatnonzero(~same_h)
        if want:
            several = np.zeros(len(first), bool)
            several[group[same_h & ~same]] = True
            ask = ~same & several[group]
            ask[:old] = False
            if carry and not asked and several[0]:
                ask[0] = True
                ask[1] = not same[1]
            if ask.any():
                yield _batch(WANTED, h=h[ask], doc=doc[ask], a=a[ask])
            asked_last = bool(several[-1]) or (asked and group[-1] == 0)
        else:
            asked_last = False
        f, last = first[-1], head[-1]
        carry = (int(h[-1]), int(hc[-1]), int(doc[last]), int(a[last]), int(doc[f]), int(a[f]), int(hc[f]), asked_last)


def _sorted(df: DataFrame, n: int, *more: str) -> DataFrame:
    return df.repartition(n, "h").sortWithinPartitions("h", *more)


CONTEXT = "h long, doc long, a long, context binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of text, doc, and arrays of h and a: the contexts' bytes."""
    for b in slices(batches):
        h, doc, a, c = [], [], [], []
        for raw, d, hs, places in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            for x, place in sorted(zip(hs, places, strict=True)):
                p = place >> 16
                h.append(x)
                doc.append(d)
                a.append(place)
                c.append((raw or b"")[p - ((place >> 8) & 255) : p + (place & 255)])
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.binary())], ["h", "doc", "a", "context"])


def _left(a: int) -> int:
    """Bytes of a context before its gram."""
    return (a >> 8) & 255


def _collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Contexts of whole grams, several at a time up to COLLECTION bytes. Batches are sorted by h."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy()
        ends = np.r_[0, np.cumsum(pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False), dtype=np.int64)]
        at = 0
        for i in np.flatnonzero(np.r_[h[0] != last, h[1:] != h[:-1]]).tolist():
            if size + ends[i] - ends[at] >= COLLECTION:
                yield pa.Table.from_batches([*held, b.slice(at, i - at)])
                held, size, at = [], 0, i
        held.append(b.slice(at))
        size, last = size + int(ends[-1] - ends[at]), h[-1]
    if held:
        yield pa.Table.from_batches(held)


def _sharing(collection: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """doc, a, offset and bytes: of the contexts of a collection, what reaches from the first to the last window that stands in
    it more than once. Contexts without one are left out. Windows are told apart by a hash: an unlucky one lets more in,
    never less, and what is let in is compared by its bytes."""
    doc, a = (collection.column(c).to_numpy() for c in (1, 2))
    column = collection.column(3).cast(pa.binary()).to_pylist()
    sizes = np.array([len(c) for c in column], np.int64)
    raw = b"".join(column)
    begin = np.cumsum(sizes) - sizes
    grams = _grams(np.frombuffer(raw + b"\0" * LENGTH, np.uint8))
    windows = np.maximum(sizes - LENGTH + 1, 0)
    own = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[own]
    # A window as grams that overlap or touch.
    key = np.zeros(len(at), np.uint64)
    for i, step in enumerate([*range(0, LENGTH - GRAM, GRAM), LENGTH - GRAM]):
        key += grams[at + step] * _ODD[i]
    order = np.argsort(key)
    key = key[order]
    equal = key[1:] == key[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    own, at = own[twice], at[twice]
    new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    of, low, high = own[new], at[new], at[np.r_[new[1:], len(own)] - 1] + LENGTH if len(own) else at
    return doc[of], a[of], low - begin[of], [raw[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)]


def _later(doc: np.ndarray, start: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, a, b: bytes of maximal repeats among contexts, without those of their first occurrences."""
    sa = SuffixArray(contexts, LENGTH, LENGTH + _REACH)
    at = sa.order
    d, s = doc[sa.owner[at]], start[sa.owner[at]] + at - sa.first[sa.owner[at]]
    order = np.lexsort((s, d))
    new = np.r_[False, (d[order][1:] != d[order][:-1]) | (s[order][1:] != s[order][:-1])] if len(at) else np.zeros(0, bool)
    place = np.zeros(sa.n, np.int64)
    place[at[order]] = np.cumsum(new)
    at, length = sa.later(place)
    own = sa.owner[at]
    begin = start[own] + at - sa.first[own]
    return doc[own], begin, begin + length


def _scan_collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for collection in _collections(batches):
        doc, a, offset, contexts = _sharing(collection)
        if not contexts:
            continue
        found = _later(doc, _span(a)[0] + offset, contexts)
        if len(found[0]):
            yield _batch(COVERED, **dict(zip(("doc", "a", "b"), _merge(*found), strict=True)))


#: A string of a group in one context: its hash and length, the context's document and anchor, its place in the context.
PLACED = "key binary, length int, doc long, a long, at int"


def _placed(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["key", "length", "doc", "a", "at"])


def _key(string: bytes) -> bytes:
    return hashlib.blake2b(string, digest_size=16).digest()


def _all_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, hc, doc, place, low, high = anchors(b.column(0).to_pylist(), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, hc, doc, _packed(place, low, high))], ["h", "hc", "doc", "a"])


def _own_places(string: bytes) -> set[int]:
    return set(anchors([0], [string])[3].tolist())


def _list_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal repeats of whole grams. A string that isn't anchored at the gram of its context can
    stand elsewhere without it: the gram that anchors it lists it."""
    for collection in _collections(batches):
        docs, anchor, cut, contexts = _sharing(collection)
        if not contexts:
            continue
        sa, doc, a = SuffixArray(contexts, LENGTH, LENGTH + _REACH), docs.tolist(), anchor.tolist()
        for length, at in sa.maximal_repeats():
            own = sa.owner[at].tolist()
            start = (at - sa.first[sa.owner[at]]).tolist()
            string = contexts[own[0]][start[0] : start[0] + length]
            offset = [int(cut[i]) + o for i, o in zip(own, start, strict=True)]
            places = _own_places(string)
            if any(_left(a[i]) - o in places for i, o in zip(own, offset, strict=True)):
                key = _key(string)
                yield _placed([(key, length, doc[i], a[i], o) for i, o in zip(own, offset, strict=True)])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context as a whole: what equal contexts share."""
    for b in batches:
        yield _placed([(_key(c), len(c), d, p, 0) for d, p, c in zip(*(k.to_pylist() for k in b.columns[1:]), strict=True)])


def _hot_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a context that is anchored at the context's gram."""
    for b in batches:
        for d, p, c in zip(*(k.to_pylist() for k in b.columns[1:]), strict=True):
            windows = [(i, c[i : i + LENGTH]) for i in range(len(c) - LENGTH + 1)]
            yield _placed([(_key(w), LENGTH, d, p, i) for i, w in windows if _left(p) - i in _own_places(w)])


def _over(a: int, context: bytes, before: bool) -> range:
    """Where windows of a context start that hold its gram and the SIDE bytes before, or after, it."""
    at, end = _left(a), len(context) - LENGTH + 1
    return range(min(at - SIDE + 1, end)) if before else range(max(0, at + GRAM + SIDE - LENGTH), min(at + 1, end))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window over a hot side under a 128-bit hash of its own, as an anchor row that reaches just over the window."""
    for b in batches:
        h, hc, doc, a = [], [], [], []
        for d, place, c, before in zip(*(k.to_pylist() for k in b.columns[1:]), strict=True):
            start = (place >> 16) - _left(place)
            for i in _over(place, c, before):
                x = hashlib.blake2b(c[i : i + LENGTH], digest_size=16).digest()
                h.append(int.from_bytes(x[:8], "little", signed=True))
                hc.append(int.from_bytes(x[8:], "little", signed=True))
                doc.append(d)
                a.append((start + i) << 16 | LENGTH)
        if h:
            yield from _combine(*(np.array(x, np.int64) for x in (h, hc, doc, a)))


class Finder:
    """The steps over one table of (doc_id, text)."""

    def __init__(self, docs: DataFrame) -> None:
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "repeats")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.n = parts(self.spark)

    def contexts(self) -> tuple[DataFrame, DataFrame]:
        """Covered intervals of equal contexts, and the contexts whose bytes have to be compared."""
        rows = _sorted(self.docs.mapInArrow(_find, SCHEMA), self.n, "hc", "doc", "a")
        found = self.scratch.keep(rows.mapInArrow(lambda it: _resolve(it, True), SCHEMA))
        del rows
        free_shuffles(self.spark)
        wanted = found.where(F.col("kind") == WANTED).groupBy("doc").agg(F.collect_list("h").alias("h"), F.collect_list("a").alias("a"))
        texts = self.docs.join(wanted, self.docs["doc_id"] == wanted["doc"]).select("text", "doc", "h", "a")
        contexts = self.scratch.keep(texts.mapInArrow(_fetch, CONTEXT))
        free_shuffles(self.spark)
        return found.where(F.col("kind") == COVERED), contexts

    def split(self, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Contexts of grams that fit one suffix array, and those of hot grams."""
        hot = self.scratch.keep(contexts.groupBy("h").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select("h"))
        return contexts.join(hot, "h", "left_anti"), contexts.join(hot, "h", "left_semi")

    def sides(self, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Contexts of hot grams dealt out by their sides: those of sides that fit one suffix array; those of hot sides, with the side."""
        at = F.shiftright("a", 8).bitwiseAND(255).cast("int")
        before = F.when(at >= SIDE, F.xxhash64("h", F.lit(1), F.substring("context", at - SIDE + 1, F.lit(SIDE))))
        after = F.when(F.length("context") >= at + GRAM + SIDE, F.xxhash64("h", F.lit(2), F.substring("context", at + GRAM + 1, F.lit(SIDE))))
        both = F.array(F.struct(before.alias("h"), F.lit(True).alias("before")), F.struct(after.alias("h"), F.lit(False).alias("before")))
        sides = hot.withColumn("_side", F.explode(both)).where("_side.h IS NOT NULL")
        sides = self.scratch.keep(sides.select("_side.h", "doc", "a", "context", "_side.before"))
        known = self.scratch.keep(sides.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1"))
        few = sides.join(known.where(F.col("_n") <= HOT).select("h"), "h", "left_semi").drop("before")
        return few, sides.join(known.where(F.col("_n") > HOT).select("h"), "h", "left_semi")

    def groups(self) -> DataFrame:
        """length, docs, starts: maximal repeats inside contexts, each with all its occurrences in the table. Of a gram with over
        HOT contexts each repeated window of LENGTH bytes is a group. (A repeat longer than a context is listed by its parts.)"""
        rows = self.scratch.keep(self.docs.mapInArrow(_all_anchors, "h long, hc long, doc long, a long").distinct())
        first = F.min(F.struct("doc", "a")).alias("first")
        classes = rows.groupBy("h", "hc").agg(first, F.count("*").alias("n"))
        # A gram that stands once has no repeat; the others' contexts are read once for each class of equal ones.
        several = rows.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h")
        classes = self.scratch.keep(classes.join(several, "h").select("h", "hc", F.col("first.doc").alias("doc"), F.col("first.a").alias("a")))
        wanted = classes.groupBy("doc").agg(F.collect_list("h").alias("h"), F.collect_list("a").alias("a"))
        texts = self.docs.dropDuplicates(["doc_id", "text"]).join(wanted, F.col("doc_id") == F.col("doc")).select("text", "doc", "h", "a")
        contexts = self.scratch.keep(texts.mapInArrow(_fetch, CONTEXT))
        few, hot = (self.scratch.keep(x) for x in self.split(contexts))
        placed = _sorted(few, self.n, "doc", "a").mapInArrow(_list_groups, PLACED).unionByName(hot.mapInArrow(_hot_groups, PLACED))
        placed = placed.unionByName(few.mapInArrow(_whole, PLACED))
        # What stands in the first of a class of equal contexts stands in all of them.
        members = rows.withColumnRenamed("doc", "_doc").withColumnRenamed("a", "_a")
        found = placed.join(classes, ["doc", "a"]).join(members, ["h", "hc"])
        start = F.shiftright("_a", 16) - F.shiftright("_a", 8).bitwiseAND(255) + F.col("at")
        at = F.sort_array(F.collect_set(F.struct(F.col("_doc").alias("doc"), start.alias("start"))))
        whole = found.groupBy("key", "length").agg(at.alias("at")).where(F.size("at") > 1)
        return whole.select("length", F.col("at.doc").alias("docs"), F.col("at.start").alias("starts"))

    def covered(self) -> DataFrame:
        """doc, a, b: intervals of bytes that a repeated string covers, except in its first occurrence. They may overlap."""
        done, contexts = self.contexts()
        few, hot = self.split(contexts)
        dealt, hot = self.sides(hot)
        few = few.unionByName(dealt)
        ends = self.scratch.keep(_sorted(few, self.n, "doc", "a").mapInArrow(_scan_collections, SCHEMA))
        rest = _sorted(hot.mapInArrow(_windows, SCHEMA), self.n, "hc", "doc", "a").mapInArrow(lambda it: _resolve(it, False), SCHEMA)
        out = done.unionByName(ends).unionByName(rest)
        return out.select("doc", "a", "b")


def _runs(raw: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int, int]:
    """Kept pieces, bytes removed, maximal removed runs."""
    kept, gone, runs, at = [], 0, 0, 0
    last = -1
    for a, b in sorted(spans):
        if a > last:
            runs += 1
        if b > last:
            kept.append(raw[at : max(a, at)])
            gone += b - max(a, at)
            at = last = b
    kept.append(raw[at:])
    return kept, gone, runs


def _spans(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("doc").agg(F.collect_list("a").alias("_from"), F.collect_list("b").alias("_to")).withColumnRenamed("doc", "_span_doc")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row for each row of docs."""
    finder = Finder(docs)
    spans = _spans(finder.covered())
    joined = finder.docs.join(spans, finder.docs["doc_id"] == spans["_span_doc"], "left").select("doc_id", "text", "_from", "_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, a, z in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = raw or b""
                kept, gone, runs = _runs(raw, list(zip(a or [], z or [], strict=True)))
                sha = hashlib.sha256()
                for piece in kept:
                    sha.update(piece)
                rows.append((len(raw), gone, runs, sha.hexdigest()))
            n, gone, runs, sha = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame) -> DataFrame:
    """The rows of docs without the covered bytes of their texts."""
    spans = _spans(Finder(docs).covered())
    joined = docs.join(spans, docs["doc_id"].cast("long") == spans["_span_doc"], "left")

    import pandas as pd

    def trim(texts, starts, ends):
        one = lambda t, a, z: t if t is None or a is None else b"".join(_runs(t.encode(), list(zip(a.tolist(), z.tolist(), strict=True)))[0]).decode(errors="ignore")
        return pd.Series([one(*x) for x in zip(texts, starts, ends, strict=True)], dtype=object)

    trim.__annotations__ = {"texts": pd.Series, "starts": pd.Series, "ends": pd.Series, "return": pd.Series}
    text = F.pandas_udf(trim, "string")(docs["text"].cast("string"), F.col("_from"), F.col("_to"))
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
