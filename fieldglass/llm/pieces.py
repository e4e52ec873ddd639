"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text's lattice has a node between any two characters, an edge for each vocabulary piece that spells the characters
between two nodes (a space stands for U+2581, and one more stands before the text), and an edge of byte pieces for each
character that no piece spells. Edges weigh exp(score / TEMPER) of the piece; where the vocabulary's scores are merge
ranks, -rank, they weigh (1 + rank) ** (-1 / TEMPER) instead. Forward filtering sums, for each node, the weight of all
paths that lead to it; backward sampling draws, from the end, the edge to come by in proportion. So a segmentation is
drawn with the probability of its weight among all segmentations. Draws are hashes of the row key, the seed and the
place: reruns agree, however rows are dealt.

No piece holds a U+2581 after another character, so the lattice has a cut before each space that follows another
character. The words between cuts are sampled independently, which equals sampling the whole lattice. All distinct words
of a group of texts are filtered at once, as arrays: a walk through a double-array trie finds the edges, and sums run over
nodes of equal place, words in order of length. Words over LONG characters, or whose sums leave the range of numbers, are
filtered one by one in logarithms.

A U+2581 in the text itself is spelled as bytes, and the space before the text is taken off again, so decoding gives the
text back, whatever it holds.

Defined cases: a null text has null ids; an empty text has none. Rows that repeat a key and text are segmented alike. An
empty table gives an empty result; extra columns are kept apart from the results (``encode`` names its own).
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared

MODEL, TEMPER, SEED = "/opt/tokenizers/piece_bpe_32k.model", 1.0, 23
MARK = "\u2581".encode()
#: Characters of text sampled at once, the longest word that is filtered together with others, and cells (12 bytes each) of
#: the lattices filtered at once.
AT_ONCE, LONG, CELLS = 1 << 20, 128, 1 << 22
#: A factor for each character, which keeps sums of usual words near 1, and the range outside of which they aren't used.
_PER_CHAR, _LEAST, _MOST = 30.0, 1e-250, 1e250
_ODD = np.uint64(0x9E3779B97F4A7C15)


def double_array(pieces: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A trie as base, check and value by slot: the child of slot s by byte c is base[s] + c if its check is s. The root is
    slot 0; value is the piece that ends there, or -1."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for piece, i in pieces.items():
        node = 0
        for c in piece:
            to = children[node].get(c)
            if to is None:
                to = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = to
        ends[node] = i
    size = 4 * len(children) + 1024
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    free = np.ones(size, bool)
    free[:257] = False  # so that no base is under 1
    low, todo = 257, [(0, 0)]
    for node, slot in todo:  # grows
        value[slot] = ends[node]
        if not children[node]:
            continue
        keys = sorted(children[node])
        while not free[low]:
            low += 1
        at, width = low, 4096
        while True:
            first = np.flatnonzero(free[at : min(at + width, size - 256)]) + at
            fit = np.ones(len(first), bool)
            for c in keys[1:]:
                fit &= free[first + (c - keys[0])]
            if fit.any():
                start = int(first[np.argmax(fit)]) - keys[0]
                break
            at += width
        base[slot] = start
        for c in keys:
            free[start + c] = False
            check[start + c] = slot
            todo.append((children[node][c], start + c))
    return base, check, value


@dataclass
class Vocabulary:
    """Pieces by their bytes (a space for U+2581), with log weights; the ids of the 256 byte pieces; a trie."""

    pieces: dict[bytes, tuple[int, float]]
    byte_ids: list[int]
    longest: int
    spelling: list[bytes] = field(default_factory=list)  # of each id; empty for control pieces
    byte_weight: float = -20.0
    plain: list[bytes] = field(default_factory=list)  # spelling with marks as spaces

    def __post_init__(self) -> None:
        if b" " not in self.pieces or any(b" " in p.lstrip(b" ") for p in self.pieces):
            raise ValueError("the vocabulary lacks U+2581, or has pieces with one after another character")
        self.plain = [s if len(s) == 1 else s.replace(MARK, b" ") for s in self.spelling]
        self.base, self.check, self.value = double_array({p: i for p, (i, _) in self.pieces.items()})
        chars = {i: len(p.decode()) for p, (i, _) in self.pieces.items()}
        self.longest_chars = max(chars.values())
        #: By id: the weight, scaled by the length; one more for no piece, and one for the bytes of a character.
        self.linear = np.zeros(len(self.spelling) + 2)
        for _, (i, w) in self.pieces.items():
            self.linear[i] = math.exp(w) * _PER_CHAR ** chars[i]
        self.linear[-1] = math.exp(self.byte_weight) * _PER_CHAR

    @classmethod
    def load(cls, model: str = MODEL, temper: float = TEMPER) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces, byte_ids, spelling, ranks = {}, [-1] * 256, [], False
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(name[3:-1], 16)] = i
                spelling.append(bytes([int(name[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spelling.append(b"")
            else:
                pieces[name.encode().replace(MARK, b" ")] = (i, sp.get_score(i))
                spelling.append(name.encode())
        if min(byte_ids) < 0:
            raise ValueError("the vocabulary has no byte pieces, so it can't spell every text")
        ranks = min(s for _, s in pieces.values()) < -1000  # log probabilities don't reach there
        weigh = (lambda s: -math.log1p(-s) / temper) if ranks else (lambda s: s / temper)
        weighed = {p: (i, weigh(s)) for p, (i, s) in pieces.items()}
        return cls(weighed, byte_ids, max(map(len, weighed)), spelling, min(w for _, w in weighed.values()) - 10)

    def edges(self, word: bytes) -> list[list[tuple[int, int, float]]]:
        """For each node after the first: (node it comes from, piece, log weight). Nodes are ends of characters; the piece
        -1 stands for the bytes of one character."""
        ends = [0] + [i for i in range(1, len(word) + 1) if i == len(word) or (word[i] & 0xC0) != 0x80]
        into: list[list[tuple[int, int, float]]] = []
        for k in range(1, len(ends)):
            here = []
            for j in range(k - 1, -1, -1):
                if ends[k] - ends[j] > self.longest:
                    break
                found = self.pieces.get(word[ends[j] : ends[k]])
                if found:
                    here.append((j, *found))
            if not here or here[0][0] != k - 1:
                here.insert(0, (k - 1, -1, self.byte_weight))
            into.append(here)
        return into


class Spelled:
    """Characters that are spelled as bytes, numbered; piece -1 - n stands for the n-th."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.number: dict[bytes, int] = {}
        self.ids, self.starts = array("i"), array("q", [0])

    def code(self, char: bytes) -> int:
        n = self.number.get(char)
        if n is None:
            n = self.number[char] = len(self.number)
            self.ids.extend(self.v.byte_ids[b] for b in char)
            self.starts.append(len(self.ids))
        return -1 - n

    def expand(self, pieces: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with those under 0 written out, and the new number of pieces of each word."""
        low = np.flatnonzero(pieces < 0)
        if not len(low):
            return pieces, per
        starts, ids = np.array(self.starts, np.int64), np.array(self.ids, np.int64)
        which = -1 - pieces[low]
        more = np.ones(len(pieces), np.int64)
        more[low] = starts[which + 1] - starts[which]
        ends = np.cumsum(more)
        out = np.repeat(pieces, more)
        size = more[low]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(ends[low] - size, size) + inner] = ids[np.repeat(starts[which], size) + inner]
        cut = np.r_[0, ends][np.r_[0, np.cumsum(per)]]
        return out, np.diff(cut)


class Lattices:
    """Lattices filtered one word at a time, in logarithms, laid out flat: for each node the edges into it, with running
    probabilities. For long words, and those whose sums leave the range of numbers."""

    def __init__(self, vocabulary: Vocabulary, spelled: Spelled | None = None) -> None:
        self.v, self.spelled = vocabulary, spelled or Spelled(vocabulary)
        self.n_nodes = self.n_words = 0
        self._node_start = array("q")  # of each word: its node 0
        self._count = array("q")  # of each word: nodes after the first
        self._keys = array("d")  # of each edge: node + running probability
        self._from = array("q")
        self._piece = array("q")

    def add(self, word: bytes) -> int:
        """Forward filtering of one word."""
        into = self.v.edges(word)
        chars = re.findall(b"[\\x00-\\x7f\\xc0-\\xff][\\x80-\\xbf]*", word) if any(e[0][1] < 0 for e in into) else []
        alpha = [0.0]
        base = self.n_nodes
        for k, here in enumerate(into, 1):
            logs = [alpha[j] + w for j, _, w in here]
            top = max(logs)
            share = [math.exp(x - top) for x in logs]
            total = sum(share)
            alpha.append(top + math.log(total))
            run = 0.0
            for (j, piece, _), p in zip(here, share, strict=True):
                run += p / total
                self._keys.append(base + k + min(run, 1.0) * 0.999999)
                self._from.append(j)
                self._piece.append(self.spelled.code(chars[k - 1]) if piece < 0 else piece)
            self._keys[-1] = base + k + 0.999999
        self.n_nodes += len(into) + 1
        self._node_start.append(base)
        self._count.append(len(into))
        self.n_words += 1
        return self.n_words - 1

    def sample(self, words: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of many words at once. words: numbers from ``add``; draws: a 64-bit hash for each. Returns
        pieces in order, and how many each word has."""
        start, count, keys, origin, piece = (np.array(x, t) for x, t in ((self._node_start, np.int64), (self._count, np.int64), (self._keys, np.float64), (self._from, np.int64), (self._piece, np.int64)))
        node, at = count[words], np.arange(len(words))
        got, step = [], 0
        while len(at):
            edge = np.searchsorted(keys, start[words[at]] + node[at] + _uniform(draws[at], step) * 0.999999, side="right")
            got.append((at, piece[edge]))
            node[at] = origin[edge]
            at = at[node[at] > 0]
            step += 1
        return _in_order(got, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(draws: np.ndarray, step: int) -> np.ndarray:
    return (_mix(draws + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _in_order(got: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces drawn from the end, step by step, as the pieces of each word in order, and their numbers."""
    per = np.zeros(n, np.int64)
    for at, _ in got:
        per[at] += 1
    ends = np.cumsum(per)
    out = np.empty(int(ends[-1]) if n else 0, np.int64)
    for step, (at, piece) in enumerate(got):
        out[ends[at] - 1 - step] = piece
    return out, per


class Filtered:
    """The lattices of many words of at most LONG characters, filtered together.

    Words are ranked by length, longest first, so the words that have a k-th node are the first n[k] ranks. Cell (k, l, r)
    is the edge of l + 1 characters into the k-th node of the word of rank r; ``sums`` runs over l."""

    def __init__(self, v: Vocabulary, words: list[str], spelled: Spelled) -> None:
        """words start with their spaces."""
        blob = "\0".join(words) + "\0"  # no piece holds a zero byte, so a walk ends with its word
        chars = np.fromiter(map(len, words), np.int64, len(words))
        self.order = np.argsort(-chars, kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))
        self.chars = chars
        most = int(chars.max())
        self.n = np.searchsorted(-chars[self.order], -np.arange(most + 1), side="right")  # ranks with a k-th node
        wide = min(v.longest_chars, most)
        lengths = np.minimum(np.arange(most + 1), wide)
        self.off = np.r_[0, 0, np.cumsum(self.n[1:] * lengths[1:])]  # off[k]: where the cells of node k begin
        none, as_bytes = len(v.linear) - 2, len(v.linear) - 1
        self.piece = np.full(self.off[-1], none, np.int32)

        raw = np.frombuffer(blob.encode("utf-8", "surrogatepass"), np.uint8)
        starts_char = (raw & 0xC0) != 0x80
        first = np.flatnonzero(starts_char)  # the first byte of each character
        inside = np.ones(len(first), bool)
        inside[np.cumsum(chars + 1) - 1] = False
        char_end = np.r_[first[1:], len(raw)][inside]
        first = first[inside]
        rank = np.repeat(self.rank, chars)
        local = np.arange(len(first)) - np.repeat(np.cumsum(chars) - chars, chars)  # the node before each character
        up_to = None if len(raw) == len(first) + len(words) else np.cumsum(starts_char)  # characters up to a byte

        origin, at = np.arange(len(first)), first
        state = np.zeros(len(first), np.int64)
        lone = np.zeros(len(first), bool)
        length = 0
        while len(at):
            to = v.base[state] + raw[at]
            alive = np.flatnonzero(v.check[to] == state)
            state, origin, at = to[alive], origin[alive], at[alive] + 1
            value = v.value[state]
            hit = np.flatnonzero(value >= 0)
            o = origin[hit]
            length = length + 1 if up_to is None else up_to[at[hit] - 1] - up_to[first[o]] + 1
            k = local[o] + length
            self.piece[self.off[k] + (length - 1) * self.n[k] + rank[o]] = value[hit]
            if up_to is None:
                if length == 1:
                    lone[o] = True
            else:
                lone[o[length == 1]] = True
        odd = np.flatnonzero(~lone)
        self.codes: dict[int, int] = {}
        weight_of = v.linear
        k = local[odd] + 1
        cell = self.off[k] + rank[odd]
        self.piece[cell] = as_bytes
        text = raw.tobytes()
        spelled_code = np.fromiter((spelled.code(text[a:b]) for a, b in zip(first[odd].tolist(), char_end[odd].tolist(), strict=True)), np.int64, len(odd))

        self.sums = weight_of[self.piece]
        self.piece[cell] = spelled_code  # under 0
        self.bad = np.zeros(len(words), bool)  # by rank
        alpha = [np.ones(len(words))]
        for k in range(1, most + 1):
            n, begin = int(self.n[k]), int(self.off[k])
            total = None
            for j in range(int(lengths[k])):
                part = self.sums[begin + j * n : begin + (j + 1) * n]
                part *= alpha[k - 1 - j][:n]
                if total is not None:
                    part += total
                total = part
            self.bad[:n] |= (total < _LEAST) | (total > _MOST)
            alpha.append(total)
        self.lengths = lengths

    def sample(self, words: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``Lattices.sample``."""
        rank, node = self.rank[words], self.chars[words]
        at, got, step = np.flatnonzero(node > 0), [], 0
        while len(at):
            k, r = node[at], rank[at]
            n, begin = self.n[k], self.off[k] + r
            goal = _uniform(draws[at], step) * self.sums[begin + (self.lengths[k] - 1) * n]
            length = np.zeros(len(at), np.int64)
            left = np.flatnonzero(self.sums[begin] <= goal)
            while len(left):
                length[left] += 1
                left = left[self.sums[begin[left] + length[left] * n[left]] <= goal[left]]
            got.append((at, self.piece[begin + length * n].astype(np.int64)))
            node[at] = k - 1 - length
            at = at[node[at] > 0]
            step += 1
        return _in_order(got, len(words))


def words_of(text: str) -> list[str]:
    """Stretches between cuts, each without the first of its spaces; together with those they are a space and the text."""
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], ""
    for p in parts[:-1]:
        if p:
            out.append(spaces + p)
            spaces = ""
        else:
            spaces += " "
    out.append(spaces + parts[-1])
    return out


def sample_group(v: Vocabulary, keys: list[int | None], texts: list[str], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and how many each has."""
    every: list[str] = []
    counts = []
    for t in texts:
        before = len(every)
        if t:
            every += words_of(t)
        counts.append(len(every) - before)
    if not every:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    words = list(dict.fromkeys(every))
    index = dict(zip(words, range(len(words)), strict=True))
    number, count = np.fromiter(map(index.__getitem__, every), np.int64, len(every)), np.array(counts, np.int64)
    hashes = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{k}") for k in keys], np.uint64)
    place = np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count)
    draws = _mix(np.repeat(hashes, count) + place.astype(np.uint64) * _ODD)

    spelled = Spelled(v)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    alone = sizes > LONG
    parts = []
    block = np.cumsum(np.where(alone, 0, sizes * np.minimum(sizes, v.longest_chars))) // CELLS
    for k in range(int(block[-1]) + 1):  # words of at most CELLS lattice cells, and one word more, at once
        some = np.flatnonzero((block == k) & ~alone)
        if not len(some):
            continue
        filtered = Filtered(v, [" " + words[i] for i in some.tolist()], spelled)
        alone[some] = filtered.bad[filtered.rank]
        within = np.full(len(words), -1, np.int64)
        within[some[~alone[some]]] = np.flatnonzero(~alone[some])
        at = np.flatnonzero(within[number] >= 0)
        parts.append((at, *filtered.sample(within[number[at]], draws[at])))
    if alone.any():
        one = Lattices(v, spelled)
        where = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(alone).tolist():
            where[i] = one.add((" " + words[i]).encode("utf-8", "surrogatepass"))
        apart = np.flatnonzero(alone[number])
        parts.append((apart, *one.sample(where[number[apart]], draws[apart])))
    pieces, per = _merged(parts, len(number))
    pieces, per = spelled.expand(pieces, per)
    return pieces, np.add.reduceat(np.r_[per, 0], np.minimum(np.cumsum(count) - count, len(per))) * (count > 0)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of words (their places, pieces one after the other, numbers of pieces) in the order of the places."""
    per = np.zeros(n, np.int64)
    for at, _, own in parts:
        per[at] = own
    starts = np.cumsum(per) - per
    out = np.empty(int(per.sum()), np.int64)
    for at, pieces, own in parts:
        out[np.repeat(starts[at] - (np.cumsum(own) - own), own) + np.arange(len(pieces))] = pieces
    return out, per


def encode_texts(v: Vocabulary, keys: list[int | None], texts: list[str | None], seed: int = SEED) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of texts of bounded size: first and end of the group, all ids one after the other, and how many each text has
    (null texts: none). A text isn't split, so a group holds AT_ONCE characters and one text more at most."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= AT_ONCE or i == len(texts) - 1:
            yield begin, i + 1, *sample_group(v, keys[begin : i + 1], [t or "" for t in texts[begin : i + 1]], seed)
            begin, size = i + 1, 0


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text that was encoded. Bytes that spell U+2581 are told apart from the mark by their pieces."""
    return b"".join(map(vocabulary.plain.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text", seed: int = SEED, temper: float = TEMPER) -> DataFrame:
    """doc_id (the key), n_pieces, piece_ids, and lossless: whether decoding gave the text back."""
    vocabulary = Shared(docs.sparkSession, Vocabulary.load(model, temper))  # a vocabulary has a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for begin, end, ids, per in encode_texts(v, keys, texts, seed):
                null = np.array([t is None for t in texts[begin:end]], bool)
                cuts = np.r_[0, np.cumsum(per)]
                flat, bounds = ids.tolist(), cuts.tolist()
                back = [None if t is None else decode_ids(v, flat[x:y]) == t for t, x, y in zip(texts[begin:end], bounds, bounds[1:], strict=False)]
                offsets = pa.array(cuts.astype(np.int32), mask=np.r_[null, False])
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0)[begin:end], pa.array(per, mask=null), lists, pa.array(back, pa.bool_())], ["doc_id", "n_pieces", "piece_ids", "lossless"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_pieces long, piece_ids array<int>, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of encoded rows."""
    vocabulary = Shared(encoded.sparkSession, Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            texts = [None if i is None else decode_ids(v, i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "piece_ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return encode(table(spark, sf_dir, "documents"))
