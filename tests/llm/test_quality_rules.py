import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from fieldglass.llm import quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(rows, min_docs, share, least_left):
    """The rules, row by row, from the docstring."""

    def norm(line):
        line = re.sub(r"\d+", "0", line.lower())
        return re.sub(r"[^\w]+", " ", line).strip()

    docs, holders = defaultdict(set), defaultdict(set)
    for _, text, source in rows:
        docs[source].add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders[source, norm(line)].add(text or "")
    frequent = {k for k, v in holders.items() if len(v) > min_docs and len(v) > share * len(docs[k[0]])}
    out, left = [], []
    for doc_id, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = text.split("\n")
        dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n, inside = Counter(grams), set()
        for i, g in enumerate(grams):
            if n[g] > 1:
                inside |= {i, i + 1, i + 2}
        gone = sum(len(WORD.findall(x)) for x in lines if WORD.search(x) and (source, norm(x)) in frequent)
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        if not failed and len(words) - gone >= least_left * len(words):
            left.append((doc_id, "\n".join(x for x in lines if not WORD.search(x) or (source, norm(x)) not in frequent), source))
        out.append((doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed, gone, not failed and len(words) - gone >= least_left * len(words)))
    return sorted(out, key=repr), sorted(left, key=repr)


def brute(*args):
    return rules(*args)[0]


def brute_left(*args):
    """The rows that stay, frequent lines taken out."""
    return rules(*args)[1]


def corpus(seed):
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice(["alpha", "béta", "g4mma", "#tag", "<b>", "délta", "epsilon", "z"]) + str(r.randrange(400)) for _ in range(n))
    boiler = ["All rights reserved 2020", "Subscribe to our letter now, it is free!", "cookie policy | terms"]
    rows = []
    for i in range(120):
        lines = [line(r.randrange(1, 12)) for _ in range(r.randrange(1, 12))]
        if i % 2:
            lines += [re.sub("2020", str(2000 + i), b) for b in boiler]
        if r.random() < 0.2:
            lines += lines[:3] * 3
        if r.random() < 0.3:
            lines += boiler * 20
        rows.append((i, "\n".join(lines), r.choice(["a", "b", None])))
    rows += [(200, None, "a"), (201, "", "a"), (202, "\n\n \t\n", None), (None, rows[3][1], "a"), rows[5], rows[5], (rows[5][0], rows[5][1], "other"), *[(rows[7][0], rows[7][1], s) for s in ("a", "b", None)], (None, None, None), (203, "one\u00a0word", "b"), (204, "x " * 3000, "b")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_judge_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_boiler_words", "kept")) for r in R.judge(df, 5, 0.05, 0.5).collect()]
    assert sorted(got, key=repr) == brute(rows, 5, 0.05, 0.5)


def test_apply_drops_the_judged_rows_and_frequent_lines_only(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("content", R.F.lit("clash")).withColumn("kept", R.F.lit(None).cast("int"))
    judged = R.judge(df, 5, 0.05, 0.5)
    left = R.apply(df, 5, 0.05, 0.5)
    assert left.columns == df.columns
    assert left.count() == judged.where("kept").count()
    assert sorted((tuple(r)[:3] for r in left.collect()), key=repr) == brute_left(rows, 5, 0.05, 0.5)


def test_frequent_lines_leave_and_others_stay(spark):
    rows = [(i, f"own line number {chr(97 + i % 26) * (i // 26 + 1)}\nshared footer", "s") for i in range(60)] + [(99, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = [r.text for r in R.strip_frequent(df, 20, 0.05).collect()]
    assert not any("footer" in t for t in texts if t) and sum(t is not None and t.startswith("own line") for t in texts) == 60 and None in texts


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, host long, line string")
    assert R.judge(df).count() == 0 and R.strip_frequent(df).count() == 0


def test_normalise_line_folds_numbers_signs_and_case():
    assert R.normalise_line("  Page 12 of 345 -- END!") == "page 0 of 0 end"
    assert unicodedata.normalize("NFC", R.normalise_line("Été")) == "été"
