import numpy as np
import pytest

from tidepool.llm import quality

MID = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = quality.op2_quality(spark, MID).toPandas().set_index("doc_id")
    marks = spark.read.parquet(f"{MID}/labels.parquet").toPandas().set_index("doc_id")
    both = rows.join(marks, how="inner")
    both = both[both.held_out]
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert (good.predicted == 1).mean() > 0.99
    assert (bad.predicted == 0).mean() > 0.95
    assert rows.score.between(0, 1).all() and len(rows) == spark.read.parquet(f"{MID}/documents.parquet").count()


def test_edge_cases(spark, odd, empty):
    marks = spark.createDataFrame([(5, 1), (6, 1), (7, 0), (11, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(odd, marks)
    got = {r["id"]: r["score"] for r in quality.score(odd, model).collect()}
    assert len(got) == odd.select("doc_id").distinct().count() and all(0 <= s <= 1 for s in got.values())
    assert got[1] == got[2]
    assert quality.train(odd, marks.where("false")) is None
    assert quality.score(empty, model).count() == 0
    assert {r["score"] for r in quality.score(odd, None).collect()} == {0.5}
    assert quality.accept(odd, model).columns == odd.columns


def naive_risk(model, p, u, prior):
    """The non-negative risk, row by row, with the penalty of the parameters."""
    soft = lambda z: np.log1p(np.exp(-abs(z))) + max(z, 0)
    mp, mu = ([float(f @ model.weights) for f in model.expand(x)] for x in (p, u))
    as_good = sum(soft(-z) for z in mp) / len(mp)
    as_bad = sum(soft(z) for z in mu) / len(mu) - prior * sum(soft(z) for z in mp) / len(mp)
    return prior * as_good + max(0.0, as_bad) + 0.5 * quality.RIDGE * float(model.weights[1:] @ model.weights[1:])


def samples(rng, n_good, n_bad):
    good = rng.normal(1, 1, (n_good, quality.FEATURES))
    bad = rng.normal(-1, 1, (n_bad, quality.FEATURES))
    return np.concatenate([good, bad]).astype(np.float32)


def test_risk_and_its_derivatives_equal_naive_ones():
    rng = np.random.default_rng(0)
    u = samples(rng, 40, 20)
    model = quality.Model(u.mean(axis=0), u.std(axis=0) + 1e-3)
    model.weights = rng.normal(0, 0.1, len(model.weights))
    d = len(model.weights)
    sums = quality.risk_sums(model, u)
    loss = lambda w: quality.risk_sums(quality.Model(model.mean, model.scale, w), u)[1]
    assert sums[0] == len(u) and sums[1] == loss(model.weights)
    for i in range(0, d, 17):
        step = np.eye(d)[i] * 1e-5
        assert sums[2 + i] == pytest.approx((loss(model.weights + step) - loss(model.weights - step)) / 2e-5, rel=1e-4, abs=1e-4)
        slope = lambda w: quality.risk_sums(quality.Model(model.mean, model.scale, w), u)[2 + i]  # noqa: E731, B023
        assert sums[2 + d + i * d + i] == pytest.approx((slope(model.weights + step) - slope(model.weights - step)) / 2e-5, rel=1e-3, abs=1e-3)


def test_fit_finds_a_least_risk_and_the_prior():
    rng = np.random.default_rng(1)
    p, u = samples(rng, 5000, 0), samples(rng, 14_000, 6000)
    first = quality.Model(u.mean(axis=0, dtype=float), u.std(axis=0, dtype=float) + 1e-3)
    sums = lambda m: quality.risk_sums(m, u)
    model = quality.minimise(sums, first, p, 0.7, 20)
    least = naive_risk(model, p, u, 0.7)
    assert least < naive_risk(first, p, u, 0.7)
    for _ in range(10):
        near = quality.Model(model.mean, model.scale, model.weights + rng.normal(0, 0.02, len(model.weights)))
        assert naive_risk(near, p, u, 0.7) > least - quality.BEND
    assert (model.score(u[:14_000]) > 0.7).mean() > 0.97 and (model.score(u[14_000:]) < 0.5).mean() > 0.97
    rough = quality.minimise(sums, first, p[::2], quality.PRIOR_GUESS, quality.PRIOR_STEPS)
    bins = lambda x: np.histogram(rough.score(x), quality.BINS, (0, 1))[0]
    assert abs(quality.estimated_prior(bins(u), bins(p[1::2])) - 0.7) < 0.1


def test_equal_texts_score_alike(spark, odd):
    marks = spark.createDataFrame([(5, 1), (9, 1)], "doc_id long, quality int")
    model = quality.train(odd, marks)
    a = quality.features(*binary([b"Hello World", b"x" * 50]))
    b = quality.features(*binary([b"some other text\n" * 20, b"Hello World"]))
    assert model.score(a)[0] == model.score(b)[1]


def binary(rows):
    offsets = np.cumsum([0, *map(len, rows)])
    return np.frombuffer(b"".join(rows), np.uint8), offsets
