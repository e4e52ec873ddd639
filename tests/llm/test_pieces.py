import math
import random
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from fieldglass.llm import pieces as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load()


def encoded(vocabulary, keys, texts, seed=P.SEED):
    out = []
    for _, _, ids, per in P.encode_texts(vocabulary, keys, texts, seed):
        cuts = np.r_[0, np.cumsum(per)].tolist()
        out += [ids[a:b].tolist() for a, b in pairwise(cuts)]
    return out


ODD = ["", " ", "  two  spaces ", "\n\ttab", "▁mark▁ ▁", "日本語 text", "é́ combining", "emoji 😀😀", "a" * 3000, "\x00\x01\x7f", "ÿþ", "word " * 500, " ▁", "▁", "x▁y  z", "٣٤", "\u2028line"]


def test_round_trip_is_lossless(vocabulary):
    r = random.Random(1)
    texts = ODD + ["".join(chr(r.choice([r.randrange(1, 128), r.randrange(128, 0xD7FF), 0x2581, 32])) for _ in range(r.randrange(200))) for _ in range(100)]
    ids = encoded(vocabulary, list(range(len(texts))), texts)
    for t, i in zip(texts, ids, strict=True):
        assert P.decode_ids(vocabulary, list(i)) == t


def test_seeds_and_keys_decide(vocabulary, monkeypatch):
    text = ["A sentence that has many segmentations, truly many of them."] * 3
    a = encoded(vocabulary, [1, 1, 2], text)
    b = encoded(vocabulary, [9, 1, 2], ["other words first", *text[1:]])
    assert a[0] == a[1] and a[1:] == b[1:] and a[0] != a[2]
    assert encoded(vocabulary, [1, 1, 2], text, seed=5) != a
    monkeypatch.setattr(P, "AT_ONCE", 1)
    assert encoded(vocabulary, [1, 1, 2], text) == a


def test_trie_holds_the_pieces(vocabulary):
    base, check, value = vocabulary.base, vocabulary.check, vocabulary.value
    for piece, (i, _) in vocabulary.pieces.items():
        slot = 0
        for c in piece:
            assert check[base[slot] + c] == slot
            slot = base[slot] + c
        assert value[slot] == i
    assert (value >= 0).sum() == len(vocabulary.pieces)


def segmentations(vocabulary, word):
    """Every path through a word's lattice with its weight, by the pieces."""
    into = vocabulary.edges(word)
    ends = [0] + [i for i in range(1, len(word) + 1) if i == len(word) or (word[i] & 0xC0) != 0x80]

    def paths(node):
        if node == len(into):
            yield (), 0.0
        for k, here in enumerate(into, 1):
            for j, p, w in here:
                if j == node:
                    own = (p,) if p >= 0 else tuple(vocabulary.byte_ids[b] for b in word[ends[j] : ends[k]])
                    for rest, more in paths(k):
                        yield (*own, *rest), w + more

    return {p: math.exp(w) for p, w in paths(0)}


@pytest.mark.parametrize("word", ["then", "  up", "aß\n", "\u2581x"])
@pytest.mark.parametrize("way", ["together", "alone"])
def test_sampling_has_the_probability_of_each_segmentation(vocabulary, word, way, monkeypatch):
    if way == "alone":
        monkeypatch.setattr(P, "LONG", 0)
    weight = segmentations(vocabulary, (" " + word).encode())
    total, n = sum(weight.values()), 30_000
    seen = Counter(map(tuple, encoded(vocabulary, list(range(n)), [word] * n)))
    assert set(seen) <= set(weight)
    for p, w in weight.items():
        assert abs(seen[p] / n - w / total) < 5 * math.sqrt(w / total / n) + 1e-4


def test_rare_sums_take_the_other_way(vocabulary):
    """A word whose sums leave the range of numbers, and one over the limit, beside usual words."""
    texts = ["\u4e00\u9fff" * 60, "ab" * 400, "usual words", "\x01" * 100 + " x"]
    for t, i in zip(texts, encoded(vocabulary, [1, 2, 3, 4], texts), strict=True):
        assert P.decode_ids(vocabulary, i) == t


def test_encode_and_decode_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(100, None, "x"), (None, "no key", "x"), (3, ODD[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string")
    got = P.encode(df)
    assert got.count() == len(rows) and got.where("NOT lossless").count() == 0 and got.where("lossless IS NULL").count() == 1
    back = {(r.doc_id, r.text) for r in P.decode(got).collect()}
    assert back == {(i, t) for i, t, _ in rows}
    assert P.encode(df.limit(0)).count() == 0
