"""Clashing column names, very long texts, and ties, for every operator that takes them."""

import random

import pytest

import corpus_pipeline as C
from fieldglass.llm import mixing, pieces, quality_rules, token_counts, url_filter

CLASH = ["row", "tie", "h", "size", "key", "a", "b", "doc", "content", "keys", "line", "host", "cell", "piece_ids", "_t", "score", "component"]


def wide(spark, rows):
    """Documents with a column of every name that operators use themselves."""
    return spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASH))


def texts(n, seed=1):
    r = random.Random(seed)
    return [" ".join(r.choice(["stone", "hill", "river", "cloud"]) + str(r.randrange(4000)) for _ in range(80)) for _ in range(n)]


@pytest.mark.parametrize("stage", range(5))
def test_stages_with_clashing_columns(spark, stage):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(30))] + [(99, None, None, None), (None, "", "en", None)]
    docs = wide(spark, rows)
    out = C.STAGES[stage][1](spark, docs, "")
    assert out.count() > 20 and (stage == 4 or out.columns == docs.columns)


def long_text():
    r = random.Random(7)
    return " ".join(r.choice(["abc", "don't", "12", "é"]) + str(r.randrange(50)) for _ in range(300_000)) + " " + "x" * 200_000


def test_very_long_text(spark):
    text = long_text()
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, "short", "en", "s")], "doc_id long, text string, lang string, source string")
    n = len(text.split())
    assert {r.doc_id: r.n_words for r in quality_rules.judge(docs).collect()} == {1: n, 2: 1}
    assert {r.doc_id: r["size"] for r in mixing.plan(docs).collect()} == {1: n, 2: 1}
    coded = pieces.encode(docs)
    assert all(r.lossless for r in coded.collect()) and {r.text for r in pieces.decode(coded).collect()} == {text, "short"}
    counted = {r.doc_id: r for r in token_counts.count_redacted(docs).collect()}
    assert counted[1].n_tokens > n / 2 and counted[2].n_pretokens == 1


def test_many_edits_of_a_long_text_match_counting_anew():
    counter = token_counts.Counter(token_counts.load_ranks())
    text = ("write to me@example.org or call 555 010 0200 and wait. " * 3000).strip()
    edits = token_counts.redaction(text)
    tree = token_counts.SegmentTree.of(text, counter)
    for e in edits:
        tree.edit(*e, counter)
    want = ("write to [mail] or call [number] and wait. " * 3000).strip()
    assert len(edits) == 6000 and tree.text == want and tree.total == sum(counter.counts(counter.split(want))) and tree.encoded < 20 * len(edits)


def test_ties(spark):
    rules = (url_filter._label("bad-b"), url_filter._label("bad-a"))
    urls = spark.createDataFrame([(1, "http://bad-b.bad-a.org/", "x")], "page_id long, url string, verdict string")
    assert [r.pattern for r in url_filter.judge(urls, patterns=rules).collect()] == ["host label bad-a"]
    same = spark.createDataFrame([(5, "a b c", "s")] * 40, "doc_id long, text string, source string")
    runs = [sorted(r.copies for r in mixing.plan(same.repartition(n)).collect()) for n in (1, 4)]
    assert runs[0] == runs[1] and abs(sum(runs[0]) - 60) <= 1


def test_repeated_ids_with_other_texts(spark):
    from fieldglass.llm import quality_classifier, toxicity

    docs = spark.createDataFrame([(1, "one text"), (1, "another text"), (1, "one text"), (None, "x")], "doc_id long, text string")
    for module, label in ((quality_classifier, "quality"), (toxicity, "toxic")):
        model = module.train(docs, spark.createDataFrame([(1, 1), (1, 0)], f"doc_id long, {label} int"))
        assert module.classify(docs, model).count() == 4
