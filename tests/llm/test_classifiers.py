import zlib

import numpy as np
import pytest

from fieldglass.llm import quality_classifier as C
from fieldglass.llm import toxicity as T

HERE = "/root/testdata/sf0.01"


def outcome(df, spark, label):
    labels = spark.read.parquet(f"{HERE}/labels.parquet").select("doc_id", label)
    return df.where("held_out").join(labels, "doc_id").collect()


def auc(rows, label):
    pos, neg = [r.score for r in rows if r[label] == 1], [r.score for r in rows if r[label] == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_quality_on_held_out_labels(spark):
    got = C.query(spark, HERE)
    rows = outcome(got, spark, "quality")
    assert len(rows) > 40 and auc(rows, "quality") > 0.8
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.75
    all_rows = got.collect()
    assert len(all_rows) == spark.read.parquet(f"{HERE}/documents.parquet").count()
    for r in all_rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_on_held_out_labels(spark):
    rows = outcome(T.query(spark, HERE), spark, "toxic")
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95


def odd(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "x"), (None, "no id"), (3, "x"), (4, "long text " * 300_000)], "doc_id long, text string").withColumn("score", C.F.lit("clash"))


@pytest.mark.parametrize("module,label", [(C, "quality"), (T, "toxic")])
def test_odd_rows_and_no_labels(spark, module, label):
    docs, none = odd(spark), spark.createDataFrame([], f"doc_id long, {label} int")
    model = module.train(docs, none)
    got = module.classify(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 3}) == 1
    assert module.classify(docs.limit(0), model).count() == 0
    one = spark.createDataFrame([(3, 1), (2, None)], f"doc_id long, {label} int")
    assert all(0 <= r.score <= 1 for r in module.classify(docs, module.train(docs, one)).collect())


def test_network_scores_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    net = C.Network.start(rng)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (0, 1, 7, 8, 9, 16, 17, 135, 136, 137, 1000, 5000, 20_000)]
    whole = C.score(net, texts)
    monkeypatch.setattr(C, "AT_ONCE", 32)
    np.testing.assert_allclose(C.score(net, texts), whole, rtol=1e-5)
    np.testing.assert_allclose([C.score(net, [t])[0] for t in texts], whole, rtol=1e-5)


def test_network_gradients():
    rng = np.random.default_rng(4)
    net = C.Network.start(rng)
    for name in ("embed", "filters", "bias", "head"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    texts, y = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (300, 40, 500)], np.array([1.0, 0.0, 1.0])

    def loss():
        flat, n = C._pack(texts)
        _, _, _, per, top = C._forward(net, flat, n)
        p = C._sigmoid(C._features(*C._pool(top, per), per) @ net.head)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for w, g in zip((net.embed, net.filters, net.bias, net.head), C._gradients(net, texts, y), strict=True):
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was = w[i]
        w[i] = was + 1e-5
        up = loss()
        w[i] = was - 1e-5
        down = loss()
        w[i] = was
        assert abs((up - down) / 2e-5 - g[i]) < 1e-4 + 0.02 * abs(g[i])


def test_pairs_count_beyond_single_terms():
    """Neither an insult nor a group's name alone is toxic; both together are. Additive weights can't say so."""
    rng = np.random.default_rng(5)
    rows, y = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted({*([1] if a else []), *([2] if b else []), *rng.integers(10, 60, 5).tolist()})))
        y.append(float(a and b))
    y = np.array(y)
    machine = T.fit(rows, y)
    place = {b: i for i, b in enumerate(machine.buckets.tolist())}
    assert {1, 2} <= set(place)
    score = lambda *bs: machine.score([np.array([place[b] for b in bs if b in place], np.int64)])[0]
    assert score(1, 2) > 0.5 > max(score(1), score(2), score())
    i, j = place[1], place[2]
    assert machine.factors[i] @ machine.factors[j] > 0.5


def test_network_matches_plain_loops():
    """Filters over each pair of blocks, the maximum of each chunk of positions, the maximum and mean over chunks."""
    rng = np.random.default_rng(9)
    net = C.Network.start(rng)
    net.head[:] = rng.normal(0, 1, net.head.shape)
    for size in (0, 3, 8, 9, 40, 700, 5000):
        text = bytes(rng.integers(1, 255, size).astype(np.uint8))
        n = C._blocks(text)
        padded = text.ljust(n * C.BLOCK, b"\0")
        blocks = [np.concatenate([net.embed[c] for c in padded[i * C.BLOCK : (i + 1) * C.BLOCK]]) for i in range(n)]
        positions = [[blocks[p] @ net.filters[:, f] + blocks[p + 1] @ net.filters[:, C.FILTERS + f] + net.bias[f] for f in range(C.FILTERS)] for p in range(n - 1)]
        chunks = [positions[i : i + C.PER_CHUNK] for i in range(0, len(positions), C.PER_CHUNK)]
        pooled = [[max(0.0, max(p[f] for p in c)) for f in range(C.FILTERS)] for c in chunks]
        most = [max(c[f] for c in pooled) for f in range(C.FILTERS)]
        mean = [sum(c[f] for c in pooled) / len(pooled) for f in range(C.FILTERS)]
        z = float(np.dot([*most, *mean, np.log(len(pooled)) / 4, 1.0], net.head))
        np.testing.assert_allclose(C.score(net, [text])[0], 1 / (1 + np.exp(-np.clip(z, -30, 30))), rtol=1e-4)


def test_machine_sums_every_pair(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(40)] + ["", None]
    every = sorted({T.bucket(t) for x in texts for t in T.terms((x or "").encode())})
    keep = np.array(every[::2], np.int64)  # terms outside of the model add nothing
    m = T.Machine(-0.3, keep, rng.normal(0, 1, len(keep)), rng.normal(0, 0.5, (len(keep), T.FACTORS)))
    place = {b: i for i, b in enumerate(keep.tolist())}
    want = {}
    for k, x in enumerate(texts):
        at = sorted({place[b] for b in map(T.bucket, T.terms((x or "").encode())) if b in place})
        z = m.constant + sum(m.weights[i] for i in at)
        for a, i in enumerate(at):
            for j in at[a + 1 :]:
                z += sum(m.factors[i][f] * m.factors[j][f] for f in range(T.FACTORS))
        want[k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in T.classify(df, m).collect():
        np.testing.assert_allclose(r.score, want[r.doc_id], rtol=1e-9)


def test_sample_is_filled_and_repeats_settle(spark):
    from fieldglass.llm.labelled import sample

    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, "x" * (500 if k % 2 else 20)) for k, i in enumerate(ids)] + [(ids[0], "another"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in [*ids, *range(1000, 1100)]], "doc_id long, quality int")
    runs = [sorted(map(tuple, sample(docs.repartition(n), labels, "quality", 10, 100).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 10 and all(len(t) <= 100 for _, t, _ in runs[0])
