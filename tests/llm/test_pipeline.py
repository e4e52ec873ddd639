import random
from collections import Counter, defaultdict

import pytest
import sentencepiece

import corpus_pipeline as C
from fieldglass.llm import pieces, quality_rules

from .test_mixing import brute_targets
from .test_near_copies import alike, grams
from .test_quality_rules import brute_left
from .test_simhash import brute_print


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    word = lambda: r.choice(["stone", "hill", "river", "élan", "cloud"]) + str(r.randrange(3000))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(i, text(r.randrange(60, 200)), "en", r.choice(["a", "a", "b", None]), 1) for i in range(200)]
    rows += [(300 + i, rows[i][1], "en", "a", 1) for i in range(20)]  # exact copies
    rows += [(400 + i, text(80) + " " + passage + " " + text(80), "en", "b", 1) for i in range(10)]
    rows += [(500, None, "en", "a", 1), (501, "", "en", "a", 1), (502, "too short", "en", "a", 1), (503, "again and " * 100, "en", "a", 1), (None, text(90), "en", "a", 1), rows[0]]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path), rows, passage


def test_stages_take_effect(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        rows_now = docs.collect()
        docs = spark.createDataFrame(rows_now, docs.schema)
        seen[name] = rows_now
    ids = lambda n: {r.doc_id for r in seen[n]}
    assert ids("quality rules") == {r[0] for r in rows} - {500, 501, 502, 503}
    assert not ids("simhash near-dedup") & set(range(300, 320)) and set(range(200)) <= ids("simhash near-dedup")
    holders = [r for r in seen["suffix-array dedup"] if passage in (r.text or "")]
    assert [r.doc_id for r in holders] == [400]
    assert len(seen["mixing sources to target weights"]) > len(seen["suffix-array dedup"])
    coded = C.STAGES[-1][1](spark, docs, path)
    assert coded.where("NOT lossless").count() == 0 and coded.count() == len(seen["mixing sources to target weights"])
    assert {r.text for r in pieces.decode(coded).collect()} == {r.text for r in seen["mixing sources to target weights"]}


def brute_near(rows):
    """Rows without those whose id has a smaller one in reach, over prints within two bits and similar five-word shingles."""
    held = [(d, brute_print(t), grams(t)) for d, t, _ in rows if d is not None]
    up = {d: d for d, _, _ in held}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, x, xs) in enumerate(held):
        for b, y, ys in held[:i]:
            if (x ^ y).bit_count() <= 2 or alike(xs, ys):
                a_, b_ = sorted((find(a), find(b)))
                up[b_] = a_
    return [r for r in rows if r[0] is None or find(r[0]) == r[0]]


def brute_cut(rows):
    """Rows without the bytes under 100-byte strings that start earlier as well, by id and start."""
    first, out = {}, []
    for d, t in sorted({(d, t) for d, t, _ in rows if d is not None}):
        raw = t.encode()
        for i in range(len(raw) - 99):
            first.setdefault(raw[i : i + 100], (d, i))
    for d, t, s in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if d is not None and first[raw[i : i + 100]] != (d, i):
                gone[i : i + 100] = b"\1" * 100
        out.append((d, bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode(errors="ignore"), s))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stages_match_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice(["stone", "hill", "river", "élan", "cloud"]) + chr(97 + r.randrange(26)) + chr(97 + r.randrange(26)) + chr(97 + r.randrange(26))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randrange(40, 70)) for _ in range(3)]
    rows = []
    for i in range(90):
        words = text(r.randrange(40, 160)).split()
        if r.random() < 0.3:
            words[20:20] = r.choice(passages).split()
        t = " ".join(words) + ("\nall rights of the host are reserved" if i % 3 else "")
        rows.append((i, t, r.choice(["a", "a", "b", None])))
        if r.random() < 0.4:  # an edited copy
            for _ in range(r.randrange(1, 7)):
                words[r.randrange(len(words))] = word()
            rows.append((1000 + i, " ".join(words), r.choice("ab")))
    rows += [(200, None, "a"), (201, "", "b"), (202, "again and " * 60, None), (203, rows[0][1], "b"), (None, rows[1][1], "a"), (None, text(80), None), rows[2], (rows[2][0], text(70), "b")]
    rows += [(300, "\n".join(["all rights of the host are reserved"] * 9), "a")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, kept int").repartition(3)
    same = lambda got, want: sorted(got, key=repr) == sorted(want, key=repr)
    now, lost = rows, []
    for (name, stage), brute in zip(C.STAGES, (lambda x: brute_left(x, quality_rules.MIN_DOCS, quality_rules.SHARE, quality_rules.LEAST_LEFT), brute_near, brute_cut), strict=False):
        docs = stage(spark, docs, "")
        got = [tuple(x)[:3] for x in docs.collect()]
        assert same(got, brute(now)), name
        lost.append(sum(len(t or "") for _, t, _ in now) - sum(len(t) for _, t, _ in got))
        now, docs = got, spark.createDataFrame([(*x, 1) for x in got], docs.schema).repartition(2)
    assert min(lost) > 0
    # The draw of the mix is random: every row is one of its input, twice at most, and sources meet their targets.
    docs = C.STAGES[3][1](spark, docs, "")
    taken = [tuple(x)[:3] for x in docs.collect()]
    times, at_most = Counter(taken), Counter(now)
    assert all(n <= 2 * at_most[x] for x, n in times.items())
    size, got, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in now:
        size[s] += len(t.split())
        longest[s] = max(longest[s], len(t.split()))
    for _, t, s in taken:
        got[s] += len(t.split())
    assert all(abs(got[s] - target) <= longest[s] for s, target in brute_targets(size).items())
    # The public library decodes every row's ids to a text that the mix took.
    coded = C.STAGES[4][1](spark, spark.createDataFrame([(*x, 1) for x in taken], docs.schema), "").collect()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert same([(x.doc_id, library.decode(x.piece_ids)) for x in coded], [x[:2] for x in taken])
    assert all(x.lossless and x.n_pieces == len(x.piece_ids) for x in coded)


def test_frequent_lines_leave_kept_documents(spark):
    letters = lambda i: chr(97 + i // 10) + chr(97 + i % 10)  # noqa: E731  (digits are folded in lines)
    own = lambda i: " ".join(letters(i) + letters(k) for k in range(60))
    rows = [(i, f"{own(i)}\nshared footer of the host", "s") for i in range(40)] + [(50 + i, own(50 + i), "t") for i in range(3)] + [(None, f"shared footer of the host\n{own(99)}", "s"), (60, "too short", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {(r.doc_id, r.text) for r in C.quality(spark, df, "").collect()}
    assert got == {(i, own(i)) for i in [*range(40), 50, 51, 52]} | {(None, own(99))}


def test_run_gives_the_last_stage(spark, folder):
    got = C.run(spark, folder[0])
    assert got.columns == ["doc_id", "n_pieces", "piece_ids", "lossless"] and got.count() > 200


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
