import random

import numpy as np
import pytest
import xxhash

from fieldglass.llm import simhash as S


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """(doc_id, text): the smallest id reachable over prints that differ in at most two bits; a repeated id links too."""
    prints = [(d, brute_print(t)) for d, t in rows]
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (a, x) in enumerate(prints):
        for j, (b, y) in enumerate(prints[:i]):
            if bin(x ^ y).count("1") <= 2 or (a == b and a is not None):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{x:016x}", least.get(find(i))) for i, (d, x) in enumerate(prints)), key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["Alpha", "beta", "gämma", "delta"]) + str(r.randrange(200))
    rows = []
    for i in range(150):
        words = [word() for _ in range(r.choice([1, 2, 3, 5, 80, 400]))]
        rows.append((r.randrange(10_000), " ".join(words)))
        for _ in range(r.randrange(4)):
            w = list(words)
            w[r.randrange(len(w))] = word()
            rows.append((r.randrange(10_000), " ".join(w)))
        if r.random() < 0.2:
            rows.append((r.randrange(10_000), "\t".join(words).upper()))
    return rows + [(20_000, None), (20_001, ""), (20_002, " \n\t"), (None, rows[0][1]), (None, "lonely null id"), rows[1], rows[1], (rows[2][0], "another text of the same id")]


@pytest.mark.parametrize("seed,limit", [(1, 1 << 16), (2, 2), (3, 8)])
def test_components_match_brute_force(spark, seed, limit):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in S.near_duplicates(df, bin_limit=limit).collect()]
    assert sorted(got, key=repr) == brute_components(rows)


def test_rows_without_an_id_link_others(spark, monkeypatch):
    monkeypatch.setattr(S, "fingerprints", lambda docs: docs)
    rows = [(7, 0b0), (None, 0b11), (3, 0b1111), (9, 15 << 40), (None, 255 << 50), (None, (255 << 50) | 3)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {(r.doc_id, r.fp): r.component_id for r in S.near_duplicates(df).collect()}
    assert got == {(7, 0): 3, (None, 0b11): 3, (3, 0b1111): 3, (9, 15 << 40): 9, (None, 255 << 50): None, (None, (255 << 50) | 3): None}


@pytest.mark.parametrize("tile", [3, 64])
def test_tiles_of_many_bins_link_inside_bins_only(tile):
    rng = np.random.default_rng(tile)
    x = (rng.integers(0, 1 << 7, 500) + (rng.integers(0, 2, 500) << 60)).astype(np.uint64)
    bins = np.sort(rng.integers(0, 60, 500))
    got, want = S._Forest(500), S._Forest(500)
    a, b = S.tile_links(x, 2, tile, bins)
    assert (np.bitwise_count(x[a] ^ x[b]) <= 2).all() and (bins[a] == bins[b]).all()
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        got.join(i, j)
    for i in range(500):
        for j in np.flatnonzero((np.bitwise_count(x ^ x[i]) <= 2) & (bins == bins[i])).tolist():
            want.join(i, j)
    assert [got.find(i) for i in range(500)] == [want.find(i) for i in range(500)]


@pytest.mark.parametrize("tile", [1, 7, 64])
def test_tiles_find_every_component(tile):
    rng = np.random.default_rng(tile)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in (0, 5, 17, 40)])
    x = np.unique(np.concatenate([base, near, near ^ np.uint64(1 << 20)]))
    a, b = S.tile_links(x, 2, tile)
    assert (np.bitwise_count(x[a] ^ x[b]) <= 2).all()
    forest, full = S._Forest(len(x)), S._Forest(len(x))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        forest.join(i, j)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2).tolist():
            full.join(i, j)
    assert [forest.find(i) == forest.find(0) for i in range(len(x))] == [full.find(i) == full.find(0) for i in range(len(x))]
    assert len({forest.find(i) for i in range(len(x))}) == len({full.find(i) for i in range(len(x))})


def test_chains_contract_to_their_smallest_node(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in S.components(df, S.Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp string, id long, bin int")
    assert S.near_duplicates(df).count() == 0


def test_long_text_print_is_that_of_all_shingles():
    r = random.Random(5)
    text = " ".join(str(r.randrange(1000)) for _ in range(40_000))
    assert S.fingerprint(text) == brute_print(text)
