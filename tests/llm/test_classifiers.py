import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import labels, quality, toxicity


def corpus(n, seed=1, bad="grudnik"):
    """Documents of random words; toxic ones (one in four) hold a word with a telling beginning, junk ones shout."""
    rnd = random.Random(seed)
    syllables = [a + b for a in "bdklmnrst" for b in "aeio"]
    docs = []
    for i in range(n):
        w = ["".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(rnd.randint(20, 120))]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            w[rnd.randrange(len(w))] = bad + rnd.choice(syllables)
        if not good:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), int(good), int(toxic)))
    return docs


def test_held_out_fold(spark):
    rows = spark.range(200).select("id", labels.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_machine_pairs_equal_the_double_sum():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality._FEATURES).astype("f4"), rng.normal(size=(quality._FEATURES, quality.FACTORS)).astype("f4"))
    for text in ("one two two THREE $$$\nline", "", None):
        ids, x = quality.features(text)
        slow = m.bias + sum(m.weights[i] * a for i, a in zip(ids, x, strict=True))
        slow += sum(m.factors[ids[i]] @ m.factors[ids[j]] * x[i] * x[j] for i in range(len(ids)) for j in range(i))
        assert m.logits([(ids, x)])[0] == pytest.approx(slow, rel=1e-4)


def test_quality_learns_and_covers_the_cases(spark):
    docs = corpus(400)
    df = spark.createDataFrame([(i, t, "x") for i, t, _, _ in docs] + [(1000, None, "x"), (None, "", "x"), (1001, "w " * 50_000, "x")], "doc_id long, text string, label string")
    known = spark.createDataFrame([(i, q) for i, _, q, _ in docs[:300]] + [(None, 1), (5, None), (7, 9)], "doc_id long, quality int")
    machine = quality.train(df, known)
    got = {r.doc_id: r for r in quality.score(df, machine).collect()}
    assert len(got) == 403 and got[0].label == "x" and all(0 <= r.quality_score <= 1 for r in got.values())
    assert np.mean([(got[i].quality_score >= 0.3) == bool(q) for i, _, q, _ in docs[300:]]) > 0.95
    assert quality.score(df.limit(0), machine).count() == 0
    assert quality.score(df, quality.train(df, known.limit(0))).first().quality_score == pytest.approx(0.5)


def test_toxicity_learns_and_covers_the_cases(spark):
    docs = corpus(500)
    long_toxic = "calm words here " * 3000 + "grudnikba " + "calm words here " * 3000
    df = spark.createDataFrame([(i, t, "x") for i, t, _, _ in docs] + [(1000, None, "x"), (None, "", "x"), (1001, long_toxic, "x")], "doc_id long, text string, label string")
    known = spark.createDataFrame([(i, t) for i, _, _, t in docs[:400]], "doc_id long, toxic int")
    net = toxicity.train(df, known)
    got = {r.doc_id: r for r in toxicity.score(df, net).collect()}
    assert len(got) == 503 and got[0].label == "x" and all(0 <= r.toxic_score <= 1 for r in got.values())
    assert np.mean([(got[i].toxic_score >= 0.5) == bool(t) for i, _, _, t in docs[400:]]) > 0.95
    assert got[1001].toxic_score >= 0.5 and got[1000].toxic_score < 0.5
    assert toxicity.score(df.limit(0), net).count() == 0
    assert toxicity.score(df, toxicity.train(df, known.limit(0))).first().toxic_score == 0.5


def test_windows_cover_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        t = toxicity.windows(np.arange(1, n + 1, dtype=np.int32))
        assert set(t.ravel()) - {0} == set(range(1, n + 1)) and t.shape[1] == toxicity.WINDOW
        assert len(t) == 1 or (t[0][toxicity.STRIDE :] == t[1][: toxicity.WINDOW - toxicity.STRIDE]).all()


def test_scores_do_not_depend_on_the_batch():
    net = toxicity.fit([(t, x) for _, t, _, x in corpus(120)], rounds=1, steps=5)
    texts = [t for _, t, _, _ in corpus(60, seed=9)]
    one = np.concatenate([net.scores([t]) for t in texts])
    assert np.allclose(one, net.scores(texts), atol=1e-5)


def test_gradients_by_differences():
    sample = [(t, x) for _, t, _, x in corpus(60, seed=2)]
    net = toxicity.fit(sample, rounds=1, steps=3)
    place: dict = {}
    numbers = [toxicity._numbered(toxicity.split(t), place) for t, _ in sample[:8]]
    table = np.stack([toxicity.windows(n)[0] for n in numbers])
    y = np.array([x for _, x in sample[:8]], dtype=float)
    word_ids, gram_ids, first = toxicity.spelled(list(place))
    word_of, grams_of = np.concatenate([[0], word_ids]), [np.zeros(0, int), *np.split(gram_ids, first[1:])]
    yes = np.ones(1 << toxicity.WORD_BITS, bool), np.ones(1 << toxicity.GRAM_BITS, bool)
    g, vectors = toxicity._gradients(net, table, y, word_of, grams_of, *yes)

    def loss():
        used, at = np.unique(table, return_inverse=True)
        inputs = np.concatenate([np.zeros((1, 2 * toxicity.DIM), "f4"), net.vectors(list(place))])[used]
        gates = np.concatenate([inputs @ net.w[f"x{d}"] + net.w[f"b{d}"] for d in (0, 1)], axis=1)
        z = net.pool(*(lambda s: (s[0], table > 0))(net.run(gates, at.reshape(table.shape))))[0]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for name in ("x0", "h1", "b0", "att", "out"):
        w, i = net.w[name], np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, e = w[i], 1e-2
        w[i] = old + e
        up = loss()
        w[i] = old - e
        down = loss()
        w[i] = old
        assert (up - down) / (2 * e) == pytest.approx(float(g[name][i]), rel=0.1, abs=2e-5), name
