import random

import pytest

from fieldglass.llm import token_counts as T


@pytest.fixture(scope="module")
def counter():
    return T.Counter(T.load_ranks())


def text_of(r, n):
    bits = ["word", " the", "'s", "'ll", "'", " ", "  ", "\n", "\t", "12", "345 ", "!?", " élan", "ß", "日本", "…", "don't", " x", "\n\n", "a" * 40]
    return "".join(r.choice(bits) for _ in range(n))


@pytest.mark.parametrize("seed", range(30))
def test_edits_match_counting_anew(counter, seed, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 1 + seed % 5)
    r = random.Random(seed)
    text = text_of(r, r.choice([0, 1, 5, 200]))
    tree = T.SegmentTree.of(text, counter)
    for _ in range(40):
        start, length = r.randrange(-2, len(text) + 3), r.randrange(0, 12)
        new = text_of(r, r.randrange(0, 4))
        tree.edit(start, length, new, counter)
        s = min(max(start, 0), len(text))
        text = text[:s] + new + text[min(s + length, len(text)) :]
        pieces = counter.split(text)
        assert tree.text == text
        assert tree.leaves() == (list(map(len, pieces)), [counter.count(p) for p in pieces])
        assert tree.total == len(counter._encoding.encode_ordinary(text)) == sum(tree.toks and [x for b in tree.toks for x in b])


def test_an_edit_touches_little(counter):
    text = " some words in a row" * 5000
    tree = T.SegmentTree.of(text, counter)
    tree.edit(50_000, 3, "new", counter)
    assert tree.encoded < 10


def test_state_follows_edits(spark, counter):
    docs = spark.createDataFrame([(1, "write to me@example.org or call +1 555 0100 200", "x"), (2, None, "y"), (3, "", "z"), (1, "another row of one id", "w")], "doc_id long, text string, counts string")
    edits = spark.createDataFrame([(1, 2, 0, 5, "send"), (1, 1, 5, 0, " it"), (9, 1, 0, 1, "")], "doc_id long, no long, start long, length long, replacement string")
    state = T.apply_edits(T.trees(docs), edits)
    for row in state.join(T.totals(state).withColumnRenamed("doc_id", "i"), state["doc_id"] == T.F.col("i")).collect():
        if row.text is None:
            assert row.counts is None and row.n_tokens is None
        elif row.doc_id != 1:
            assert row.n_tokens == 0
    texts = sorted(r.text for r in state.collect() if r.doc_id == 1)
    assert texts == sorted(["send it to me@example.org or call +1 555 0100 200", "sender it row of one id"]) or all(t.startswith("send") for t in texts)
    for r in state.where("doc_id = 1").collect():
        assert sum(r.counts) == len(counter._encoding.encode_ordinary(r.text))


def test_query_counts(spark, counter):
    docs = spark.createDataFrame([(1, "mail me@example.org now, 555 010 0200!"), (2, None), (3, ""), (4, "clean text")], "doc_id long, text string")
    got = {r.doc_id: r for r in T.count_redacted(docs).collect()}
    assert got[2].n_tokens is None and got[3].n_tokens == 0 and got[4].n_edits == 0 and got[1].n_edits == 2
    assert got[1].n_tokens_edited == len(counter._encoding.encode_ordinary("mail [mail] now, [number]!"))
    assert T.count_redacted(docs.limit(0)).count() == 0
