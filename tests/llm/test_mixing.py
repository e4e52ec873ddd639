import random
import re

import numpy as np
import pytest

from fieldglass.llm import mixing as M


def brute_targets(sizes):
    """The contract: shares by weight, held at twice the size, the excess shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, [(5, 2, 1)[i % 3] for i in range(len(names))], strict=True))
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def corpus(seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(1.1) * 3)), r.choice(["hot"] * 6 + ["b", "ä", "Z", None])) for i in range(3000)]
    return rows + [(9000, None, "hot"), (9001, "", "b"), (None, "a b c", "b"), rows[0], rows[0], (9002, None, "void")]


@pytest.mark.parametrize("seed,group", [(1, 2048), (2, 16), (3, 2)])
def test_plan_meets_targets(spark, seed, group):
    rows = corpus(seed)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, longest = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
        longest[s] = max(longest.get(s, 0), words(t))
    want = brute_targets(sizes)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.plan(df.repartition(5), group=group).collect()
    assert len(got) == len(rows)
    by_target = {}
    for r in got:
        assert 0 <= r.copies <= 2 and (r["size"] > 0 or r.copies == 0)
        by_target.setdefault((r.target, r.source_size), []).append(r)
    assert {round(k[0], 6) for k in by_target} == {round(x, 6) for x in want.values()}
    for s, t in want.items():
        rs = next(v for k, v in by_target.items() if abs(k[0] - t) < 1e-6 and k[1] == sizes[s])
        assert abs(sum(r.copies * r["size"] for r in rs) - t) <= longest[s]
    again = M.plan(df.repartition(2), group=group).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.copies)
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(again, key=key)]


def test_pivot_keeps_the_sum_and_the_mean():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 100, 40).astype(float), rng.random(40)
    total = np.zeros(40)
    for _ in range(3000):
        out, at = M.pivot(size, p, rng.random(40))
        assert abs((size * out).sum() - (size * p).sum()) < 1e-6
        assert all(x in (0.0, 1.0) or i == at for i, x in enumerate(out))
        total += out
    assert np.abs(total / 3000 - p).max() < 0.05


def test_mix_repeats_rows_and_keeps_columns(spark):
    rows = [(i, "w " * 10, "a", "x") for i in range(50)] + [(100, None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    out = M.mix(df)
    assert out.columns == df.columns
    n = out.count()
    assert abs(n - 75) <= 1 and out.where("text IS NULL").count() == 0


def test_rows_without_an_id_or_with_one_id_meet_their_sources_targets(spark):
    rows = [(None if i % 2 else 7, f"w{i} " + "w " * 9, "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = brute_targets(dict.fromkeys("abc", 1000))
    out = M.mix(df).collect()
    for s in "abc":
        assert abs(sum(10 for r in out if r.source == s) - want[s]) <= 10
    again = M.mix(df.repartition(2)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, target double")
    assert M.plan(df).count() == 0 and M.mix(df).count() == 0
