import random

import numpy as np
import pytest

import corpus_pipeline as C
from fieldglass.llm import near_copies as N


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(x, y):
    return bool(x and y) and len(x & y) >= 0.8 * len(x | y)


def edited(seed):
    """Texts of 100 to 300 words with copies that have words changed, some beyond a similarity of 0.8."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    rows = []
    for i in range(40):
        words = [word() for _ in range(r.randrange(100, 300))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(r.randrange(5)):
            w = list(words)
            for at in r.sample(range(len(w)), r.randrange(1, 9)):
                w[at] = word()
            rows.append((len(rows), " ".join(w)))
    return rows + [(900, None), (901, ""), (902, "two words"), (903, "Two  WORDS"), (None, rows[0][1]), rows[3], (rows[5][0], "another text of the same id")]


def brute(rows):
    rows = [(d, grams(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in rows}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if alike(x, y):
                a_, b_ = sorted((find(a), find(b)))
                up[b_] = a_
    return {d: find(d) for d in up}


@pytest.mark.parametrize("seed,cell", [(1, 1 << 21), (2, 400)])
def test_the_stage_drops_edited_copies(spark, seed, cell, monkeypatch):
    monkeypatch.setattr(N.pairs, "__defaults__", (cell,))
    rows = edited(seed)
    want = brute(rows)
    least = {d for d, root in want.items() if d == root}
    assert 40 < len(least) < len(want) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = {r.doc_id for r in C.near_duplicates(spark, df, "").collect()}
    assert left - {None, 900, 901, 902, 903} == least - {900, 901, 902, 903} and None in left and 902 in left and 903 not in left


def test_similar_is_exact_at_the_limit():
    base = np.arange(90, dtype=np.uint64)
    # 80 shared of 100 is a similarity of 0.8; 79 of 101 isn't.
    assert N.similar([base, np.r_[base[:80], np.arange(200, 210)].astype(np.uint64)])[1] == [1]
    assert N.similar([base, np.r_[base[:79], np.arange(200, 211)].astype(np.uint64)])[1] == []


def test_empty_table(spark):
    assert N.pairs(spark.createDataFrame([], "doc_id long, text string, id long, size int, key long")).count() == 0
