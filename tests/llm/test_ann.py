import numpy as np
import pytest

from fieldglass.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    best = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, np.float32)
        best.setdefault(i, v)
    ids = np.array(sorted(best))
    x = np.stack([best[i] for i in ids]).astype(float)
    out = {}
    for q in ids[ids % every == 0]:
        score = (x * best[q].astype(float)).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 16)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, [float("inf")] * 16), (None, rows[0][1]), (1020, []), rows[40], rows[40]]
    rows += [(2000 + i, rows[7][1]) for i in range(60)]  # many equal vectors: ties
    got, want = found(A.nearest(frame(spark, rows), probes=64, rerank=400)), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        np.testing.assert_allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


@pytest.mark.parametrize("cell", [4096, 50])
def test_recall(spark, cell):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (60, 32))
    x = (centres[rng.integers(0, 60, 6000)] + rng.normal(0, 0.35, (6000, 32))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got, want = found(A.nearest(frame(spark, rows), cell=cell)), brute(rows)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])
    assert recall >= 0.95
    exact = x.astype(float)
    for q, hits in got.items():
        assert len(hits) == 20 and hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        for i, s in hits[:3]:
            assert abs(s - (exact[i] * exact[q]).sum()) < 1e-12


def test_fewer_rows_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [2.0, 1.0])]
    assert found(A.nearest(frame(spark, rows))) == brute(rows)
    assert A.nearest(frame(spark, [(0, [1.0])])).count() == 0
    assert A.nearest(frame(spark, []).limit(0)).count() == 0


def test_spread_vectors_take_more_lists(spark):
    """Without clusters the lists that are near hold few of the neighbours: more of them are visited."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (5000, 32)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(10_000 + i, [float(c) for c in x[1]]) for i in range(1000)]
    got, want = found(A.nearest(frame(spark, rows))), brute(rows)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()]) >= 0.95


def test_best_takes_the_earlier_of_equals():
    assert A._best(np.array([1.0, 3.0, 2.0, 3.0, 2.0, 2.0]), 4).tolist() == [1, 3, 2, 4]


def test_every_query_gets_k_even_from_small_lists(spark):
    rng = np.random.default_rng(4)
    groups = [(rng.normal(0, 1, 16) * 3).astype(np.float32) for _ in range(11)]
    rows = [(i, [float(c) for c in groups[0 if i < 5 else 1 + i % 10]]) for i in range(1000)]
    got = found(A.nearest(frame(spark, rows)))
    assert set(got) == set(range(0, 1000, 20)) and all(len(v) == 20 for v in got.values())


def test_copies_of_one_vector_leave_room_for_others(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (2000, 16)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[11][1]) for i in range(1000)]  # a third of all rows
    got, want = found(A.nearest(frame(spark, rows))), brute(rows)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hit >= 0.95 * sum(map(len, want.values()))


def test_doubles_are_scored_as_doubles_and_lengths_apart(spark):
    rows = [(i, [1.0 + i * 1e-12, 2.0, 0.5]) for i in range(30)] + [(100 + i, [1.0, float(i + 1)]) for i in range(5)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, list string, rank int").repartition(3)
    got = found(A.nearest(df))
    for q, own in ((0, rows[:30]), (20, rows[:30]), (100, rows[30:])):
        v = dict(own)[q]
        want = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in own if i != q))[:20]
        assert [i for i, _ in got[q]] == [i for _, i in want]
        np.testing.assert_allclose([s for _, s in got[q]], [-s for s, _ in want], rtol=1e-15)


def test_a_list_loses_no_neighbour_to_coarse_codes():
    r = np.random.default_rng(4)
    # Tight groups in many dimensions: the codes tell the groups apart, not the rows of one.
    x = (r.normal(size=(4, 384))[r.integers(4, size=3000)] + 0.05 * r.normal(size=(3000, 384))).astype(np.float32)
    index, ids = A.fit(x[:1500], 1), np.arange(3000)
    _, codes = index.encode(x)
    asked = ids[::100]
    q, v, s = A._search_cell(index, codes, ids, x, asked, x[asked], 20, 200)
    exact = x[asked].astype(np.float64) @ x.astype(np.float64).T
    exact[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-exact, axis=1, kind="stable")[:, :20]
    assert q == np.repeat(asked, 20).tolist() and v == want.ravel().tolist()
    assert np.allclose(s, np.take_along_axis(exact, want, axis=1).ravel(), rtol=0, atol=1e-9)
