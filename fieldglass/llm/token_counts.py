"""Token counts that follow edits: a segment tree of pre-tokens for each document.

The splitting pattern cuts a text into pre-tokens, which the byte-pair vocabulary encodes independently. A tree's leaves are
blocks of pre-tokens with their lengths and counts; inner nodes hold sums of characters and tokens. An edit (start, length,
replacement) finds its block by descending through the sums. Pre-tokens from just before the edit (a match can look
CONTEXT characters ahead) are split and encoded anew until a new boundary meets an old one behind the edit: from there on
nothing changes, as the pattern never looks back. Only the sums above the touched blocks are updated.

State is a table: doc_id, text, and the leaves' lengths and counts, so later edits start from the counts they find.

Defined cases: null texts have null counts and take no edits; empty texts count 0. Edits beyond the text are clipped.
Edits of a document apply in the order of their number, each on the outcome of the one before. Rows that repeat an id all
take its edits. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The byte-level vocabulary's own splitting pattern: contractions, words, numbers, signs, spaces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
CONTEXT, BLOCK, CACHED = 3, 64, 300_000


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Counter:
    """Splits texts and counts the tokens of pre-tokens, with a bounded memory of those seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._seen: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, piece: str) -> int:
        n = self._seen.get(piece)
        if n is None:
            if len(self._seen) >= CACHED:
                self._seen.clear()
            n = len(self._encoding.encode_ordinary(piece))
            if len(piece) <= 64:
                self._seen[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        found = list(map(self._seen.get, pieces))
        return [self.count(p) if n is None else n for p, n in zip(pieces, found, strict=True)] if None in found else found


class SegmentTree:
    """The tree of one text. ``total`` is its token count; ``encoded`` counts pre-tokens encoded by edits so far."""

    def __init__(self, text: str, lens: list[int], counts: list[int]) -> None:
        self.encoded = 0
        self._build(text, lens, counts)

    @classmethod
    def of(cls, text: str, counter: Counter) -> SegmentTree:
        pieces = counter.split(text)
        return cls(text, list(map(len, pieces)), counter.counts(pieces))

    def _build(self, text: str, lens: list[int], counts: list[int]) -> None:
        n = max(1, -(-len(lens) // BLOCK))
        self.size = 1 << (n - 1).bit_length()
        spare = self.size - n + (not lens)
        self.lens = [lens[i : i + BLOCK] for i in range(0, len(lens), BLOCK)] + [[] for _ in range(spare)]
        self.toks = [counts[i : i + BLOCK] for i in range(0, len(lens), BLOCK)] + [[] for _ in range(spare)]
        self.chars, self.sums, self.parts, at = [0] * (2 * self.size), [0] * (2 * self.size), [], 0
        for i in range(self.size):
            self.chars[self.size + i], self.sums[self.size + i] = sum(self.lens[i]), sum(self.toks[i])
            self.parts.append(text[at : at + self.chars[self.size + i]])
            at += self.chars[self.size + i]
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    @property
    def total(self) -> int:
        return self.sums[1]

    def leaves(self) -> tuple[list[int], list[int]]:
        return [x for b in self.lens for x in b], [x for b in self.toks for x in b]

    def _block_at(self, place: int) -> tuple[int, int]:
        """The block that holds a character, and where the block starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if start + self.chars[node] <= place:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _set(self, block: int, text: str, lens: list[int], counts: list[int]) -> None:
        self.parts[block], self.lens[block], self.toks[block] = text, lens, counts
        node = block + self.size
        self.chars[node], self.sums[node] = sum(lens), sum(counts)
        while node > 1:
            node //= 2
            self.chars[node], self.sums[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, length: int, replacement: str, counter: Counter) -> None:
        """Only the blocks around the edit are read: as many as it takes to meet an old boundary again."""
        old = self.chars[1]
        start = min(max(start, 0), old)
        end = min(start + max(length, 0), old)
        shift = len(replacement) - (end - start)
        # Left of the edit: keep pre-tokens that end at least CONTEXT characters before it.
        first, at = self._block_at(max(0, min(start - CONTEXT, old - 1)))
        begin, keep = at, 0
        while keep < len(self.lens[first]) and at + self.lens[first][keep] + CONTEXT <= start:
            at += self.lens[first][keep]
            keep += 1
        stop, span = first + 1, at + len(self.parts[first]) - (at - begin)  # blocks read, and where they end in the old text
        more = 1
        while True:
            while stop < self.size and (span < end or more):
                span += len(self.parts[stop])
                more -= bool(more) and span >= end
                stop += 1
            found = self._split(first, at, keep, begin, stop, start, end, replacement, shift, counter)
            if found:
                break
            more = 2 * (stop - first)
        text, lens, counts, block, index, place = found
        self.encoded += len(lens)
        rest = (self.parts[block][sum(self.lens[block][:index]) :], self.lens[block][index:], self.toks[block][index:]) if block < self.size else ("", [], [])
        head = (self.parts[first][: at - begin], self.lens[first][:keep], self.toks[first][:keep])
        for b in range(first + 1, min(block + 1, self.size)):
            if self.lens[b]:
                self._set(b, "", [], [])
        self._set(first, head[0] + text + rest[0], head[1] + lens + rest[1], head[2] + counts + rest[2])
        if len(self.lens[first]) > 8 * BLOCK:
            self._build(self.text, *self.leaves())

    def _split(self, first: int, at: int, keep: int, begin: int, stop: int, start: int, end: int, replacement: str, shift: int, counter: Counter) -> tuple | None:
        """Pre-tokens from ``at`` until a boundary is an old one, moved by the edit; nothing if the blocks before ``stop`` don't
        hold one. A boundary before the last character read doesn't depend on what follows."""
        was = self.parts[first][at - begin :] + "".join(self.parts[first + 1 : stop])
        now = was[: start - at] + replacement + was[end - at :]
        whole = not any(self.parts[stop:])
        block, index, place = first, keep, at  # a cursor over old boundaries
        lens, counts, here = [], [], at
        for m in counter.pattern.finditer(now):
            if here >= start + len(replacement):
                while place + shift < here and block < stop:
                    if index < len(self.lens[block]):
                        place += self.lens[block][index]
                        index += 1
                    else:
                        block, index = block + 1, 0
                if place >= end and place + shift == here and block < stop:
                    return now[: here - at], lens, counts, block, index, place
            piece = m.group()
            lens.append(len(piece))
            counts.append(counter.count(piece))
            here += len(piece)
        return (now, lens, counts, self.size, 0, 0) if whole else None


LEAVES = "doc_id long, text string, lens array<int>, counts array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lens", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def trees(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """State of all documents: their leaves."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks))  # a vocabulary has a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                pieces = [None if t is None else counter.split(t) for t in part.column(1).to_pylist()]
                lens = [None if p is None else list(map(len, p)) for p in pieces]
                counts = [None if p is None else counter.counts(p) for p in pieces]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lens, _ARROW[2].type), pa.array(counts, _ARROW[3].type)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, LEAVES)


def totals(state: DataFrame) -> DataFrame:
    """doc_id, n_pretokens, n_tokens."""
    return state.select("doc_id", F.when(F.col("counts").isNotNull(), F.size("counts")).cast("long").alias("n_pretokens"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"))


def apply_edits(state: DataFrame, edits: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The state after edits (doc_id, no, start, length, replacement), with n_encoded: pre-tokens encoded for it."""
    shared = state.sparkSession.sparkContext.broadcast(load_ranks(ranks))
    each = F.struct(F.col("no").cast("long").alias("no"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.coalesce("replacement", F.lit("")).alias("replacement"))
    grouped = edits.groupBy(F.col("doc_id").cast("long").alias("_edit_id")).agg(F.array_sort(F.collect_list(each)).alias("_edits"))
    joined = state.join(grouped, state["doc_id"] == grouped["_edit_id"], "left").select("doc_id", "text", "lens", "counts", "_edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            out: list[tuple] = []
            for doc, text, lens, counts, todo in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = 0
                if text is not None and todo:
                    tree = SegmentTree(text, lens, counts)
                    for e in todo:
                        tree.edit(e["start"], e["length"], e["replacement"], counter)
                    (lens, counts), text, n = tree.leaves(), tree.text, tree.encoded
                out.append((doc, text, lens, counts, n))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=False)], pa.array(cols[4], pa.int64())], names=[*_ARROW.names, "n_encoded"])

    return joined.mapInArrow(run, LEAVES + ", n_encoded long")


#: Personal data that the registered query edits out of texts: mail addresses, and long numbers such as phones.
PERSONAL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\+?\d[\d ()-]{7,}\d")


def redaction(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, length, replacement) that mask personal data, from the last to the first."""
    found = [(m.start(), len(m.group()), "[mail]" if "@" in m.group() else "[number]") for m in PERSONAL.finditer(text)]
    return found[::-1]


def count_redacted(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_edits, n_encoded and n_tokens_edited: counts of whole texts before and after masking
    personal data, the second from the first by edits of the tree."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        names = ["doc_id", "n_pretokens", "n_tokens", "n_edits", "n_encoded", "n_tokens_edited"]
        for b in batches:
            rows: list[tuple] = []
            for text in b.column(1).to_pylist():
                if text is None:
                    rows.append((None,) * 5)
                    continue
                pieces = counter.split(text)
                counts = counter.counts(pieces)
                before, edits, after, encoded = sum(counts), redaction(text), None, 0
                if edits:
                    tree = SegmentTree(text, list(map(len, pieces)), counts)
                    for e in edits:
                        tree.edit(*e, counter)
                    after, encoded = tree.total, tree.encoded
                rows.append((len(pieces), before, len(edits), encoded, before if after is None else after))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_encoded long, n_tokens_edited long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_redacted(table(spark, sf_dir, "documents"))
