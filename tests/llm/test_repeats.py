import hashlib
import os
import random

import pyarrow as pa
import pytest

from fieldglass.llm import repeats
from fieldglass.llm.suffix_array import SuffixArray, maximal_repeats


def brute(docs):
    """The contract, window by window."""
    first, out = {}, []
    rows = sorted({(d, t) for d, t in docs if d is not None})
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 99):
            first.setdefault(raw[i : i + 100], (d, i))
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if d is not None and first[raw[i : i + 100]] != (d, i):
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["ab", "de", "élan", "qu", "x", "stone", "hill"]) + r.choice(["", "s", "ing", "er", "ü"]) + str(r.randrange(50))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randrange(10, 120)) for _ in range(6)]
    docs = []
    for i in range(40):
        parts = [text(r.randrange(0, 30)) if r.random() < 0.6 else r.choice(passages) for _ in range(r.randrange(1, 6))]
        t = " ".join(parts)
        if r.random() < 0.3 and len(t) > 20:  # a near copy
            at = r.randrange(len(t))
            t = t[:at] + "#" + t[at + 1 :]
        docs.append((i * 3, t))
    docs += [(500 + i, docs[i][1]) for i in range(5)]
    docs += [(600, "na " * 400), (601, "na " * 200), (602, None), (603, ""), (604, "short"), (None, docs[0][1]), (700, docs[7][1]), (700, docs[7][1])]
    common = "the same hundred bytes of boiler plate stand in each of these documents, whatever goes before or comes after it, always"
    docs += [(800 + i, text(3) + common + text(3)) for i in range(30)]
    return docs


@pytest.mark.parametrize("seed,hot,segment", [(1, 20_000, 1 << 17), (2, 3, 64), (3, 10, 300), (4, 20, 1 << 17)])
def test_digest_matches_brute_force(spark, monkeypatch, seed, hot, segment):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in repeats.digest(df).collect()), key=str)
    assert got == brute(docs)


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 3), (3, 12)])
def test_groups_list_all_occurrences(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus(seed)
    raw = {d: (t or "").encode() for d, t in docs if d is not None}
    where = {}
    for d, t in raw.items():
        for i in range(len(t) - 99):
            where.setdefault(t[i : i + 100], set()).add((d, i))
    open_ = {w for w, at in where.items() if len(at) > 1}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    seen = set()
    for r in repeats.Finder(df).groups().collect():
        at = list(zip(r.docs, r.starts, strict=True))
        d, i = at[0]
        s = raw[d][i : i + r.length]
        assert len(s) == r.length >= 100 and s not in seen
        seen.add(s)
        every = {(d, i) for d, i in where[s[:100]] if raw[d][i : i + r.length] == s}
        assert len(at) > 1 and set(at) == every and len(at) == len(every)
        open_ -= {s[k : k + 100] for k in range(len(s) - 99)}
    assert seen and not open_


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, a long, doc long, h string")
    assert repeats.digest(df).count() == 0
    assert repeats.cut(df).columns == df.columns


def test_cut_keeps_columns_and_clean_texts(spark):
    long = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, long, "x"), (2, "before " + long, "y"), (3, "clean", None)], "doc_id long, text string, doc string")
    rows = {r.doc_id: r for r in repeats.cut(df).collect()}
    assert rows[1].text == long and rows[3].text == "clean" and rows[2].text == "before "


def brute_maximal(strings, least):
    where = {}
    for k, s in enumerate(strings):
        for i in range(len(s)):
            for n in range(least, len(s) - i + 1):
                where.setdefault(s[i : i + n], []).append((k, i))
    out = []
    for s, at in where.items():
        if len(at) > 1:
            left = {strings[k][i - 1 : i] if i else (k, i) for k, i in at}
            right = {strings[k][i + len(s) : i + len(s) + 1] or (k, i) for k, i in at}
            if len(left) > 1 and len(right) > 1:
                out.append((len(s), sorted(at)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_maximal_repeats_match_brute_force(seed):
    r = random.Random(seed)
    strings = [bytes(r.choice(b"ab" if seed % 2 else b"abc") for _ in range(r.randrange(0, 40))) for _ in range(r.randrange(1, 6))]
    assert sorted(maximal_repeats(strings, 3)) == brute_maximal(strings, 3)


@pytest.mark.parametrize("seed", range(6))
def test_order_and_common_prefixes_match_brute_force(seed):
    r = random.Random(seed)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 90))) for _ in range(r.randrange(1, 6))] * 2
    for least, depth in ((1, 1), (3, 8), (5, 9), (5, 17), (10, 24), (10, 25), (12, 60), (1, 200)):
        sa = SuffixArray(strings, least, depth)
        own, at = sa.owner[sa.order], sa.order - sa.first[sa.owner[sa.order]]
        got = [strings[k][i : i + depth] for k, i in zip(own, at, strict=True)]
        assert sorted(zip(own, at, strict=True)) == [(k, i) for k, s in enumerate(strings) for i in range(len(s) - least + 1)]
        assert got == sorted(got)
        assert sa.lcp[1:].tolist() == [len(os.path.commonprefix([x, y])) for x, y in zip(got, got[1:], strict=False)]


def test_only_shared_windows_enter_a_suffix_array(monkeypatch):
    r = random.Random(5)
    some = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    gram, before, after = some(32), some(60), some(60)
    # The first three agree on both sides of the gram with a later one, the others on one side, without a common window.
    both = [some(8) + before + gram + after + some(8) for _ in range(3)]
    one = [some(8) + before + gram + some(68) for _ in range(40)] + [some(68) + gram + after + some(8) for _ in range(40)]
    contexts = both + one
    rows = [pa.array(x, t) for x, t in (([7] * 83, pa.int64()), (range(83), pa.int64()), ([(68 << 16) | (68 << 8) | 100] * 83, pa.int64()), (contexts, pa.binary()))]
    batch = pa.RecordBatch.from_arrays(rows, ["h", "doc", "a", "context"])
    entered = []

    class Seen(SuffixArray):
        def __init__(self, strings, least, depth):
            entered.extend(strings)
            super().__init__(strings, least, depth)

    monkeypatch.setattr(repeats, "SuffixArray", Seen)
    found = [tuple(x) for b in repeats._scan_collections(iter([batch])) for x in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
    assert sorted(found) == [(1, 8, 160), (2, 8, 160)]
    assert entered == [before + gram + after] * 3
    # Grams that span batches are one collection.
    for cut in (1, 2, 50):
        parts = [batch.slice(0, cut), batch.slice(0, 0), batch.slice(cut)]
        again = [tuple(x) for b in repeats._scan_collections(iter(parts)) for x in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
        assert sorted(again) == sorted(found)


@pytest.mark.parametrize("limit", [1, 100, 500, 1 << 20])
def test_collections_hold_whole_grams(monkeypatch, limit):
    monkeypatch.setattr(repeats, "COLLECTION", limit)
    h = [1, 1, 2, 3, 3, 3, 4, 4, 5]
    batch = pa.RecordBatch.from_arrays([pa.array(h), pa.array(range(9)), pa.array([0] * 9), pa.array([b"x" * 60] * 9, pa.binary())], ["h", "doc", "a", "context"])
    for cut in range(10):
        got = [(t.column(0).to_pylist(), t.column(1).to_pylist()) for t in repeats._collections(iter([batch.slice(0, cut), batch.slice(cut)]))]
        assert [x for _, docs in got for x in docs] == list(range(9)) and all(docs for _, docs in got)
        assert all(a[0][-1] != b[0][0] for a, b in zip(got, got[1:], strict=False))
        assert all(60 * len(x[:-1]) < limit + 60 * 3 for x, _ in got)
