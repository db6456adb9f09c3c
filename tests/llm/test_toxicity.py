import zlib

import numpy as np

from palaver.llm import toxicity
from palaver.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    p = toxicity.query(spark, sf).toPandas()
    assert len(p) == table(spark, sf, "documents").count()
    assert (p.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in p.doc_id]).all()
    assert p.score.between(0, 1).all() and (p.predicted == (p.score >= 0.5)).all()
    m = p[p.held_out].merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    hit = ((m.predicted == 1) & (m.toxic == 1)).sum()
    assert hit >= 0.8 * (m.toxic == 1).sum()
    assert hit >= 0.9 * (m.predicted == 1).sum()


def test_fit_separates_and_keeps_the_prior():
    rng = np.random.default_rng(0)
    toxic = [np.unique(np.r_[7, rng.integers(100, 400, 20)]).astype(np.int32) for _ in range(100)]
    clean = [np.unique(rng.integers(100, 400, 20)).astype(np.int32) for _ in range(900)]
    rows = toxic[:50] + toxic[50:] + clean
    w, b = toxicity.fit(rows, np.r_[np.ones(50, bool), np.zeros(950, bool)], 0.05)
    assert b + w[7] > 0 and np.mean([b + w[x].sum() > 0 for x in clean]) < 0.05


def test_edges(spark):
    d = spark.createDataFrame([(1, "you idiot", 0.5), (None, None, 0.5), (3, "", 0.5), (3, "", 0.5), (4, "idiot " * 50_000, 0.5)], "doc_id long, text string, score_old double")
    labels = spark.createDataFrame([(None, 1), (9, None)], "doc_id long, toxic int")
    m = toxicity.train(d, labels)
    rows = toxicity.score(d, m).collect()
    assert len(rows) == 5 and all(abs(r.score - m.prior) < 1e-9 for r in rows)
    assert toxicity.score(d.limit(0), m).count() == 0


def test_fit_against_a_plain_version():
    """Adam on the non-negative risk, written out over a dense matrix and with numeric derivatives."""
    rng = np.random.default_rng(1)
    rows = [np.unique(np.r_[rng.integers(0, 4, 2), rng.integers(10, 40, 6)]).astype(np.int32) for _ in range(30)] + [np.unique(rng.integers(8, 40, 8)).astype(np.int32) for _ in range(170)]
    positive, prior, steps, l2 = np.arange(200) < 30, 0.2, 12, 4e-4
    w, b = toxicity.fit(rows, positive, prior, steps=steps)
    x = np.zeros((200, 40))
    for i, r in enumerate(rows):
        x[i, r] = 1
    use = (x[positive].sum(0) >= 3) & (x[positive].mean(0) >= 1.5 * (x[~positive].sum(0) + 0.5) / 170)
    assert set(np.flatnonzero(w)) <= set(np.flatnonzero(use)) and use.sum() >= 4
    x = np.c_[x[:, use], np.ones(200)]
    theta = np.r_[np.zeros(use.sum()), np.log(prior / (1 - prior))]
    m = v = np.zeros_like(theta)

    def negative(t):
        z = x @ t
        return np.logaddexp(0, z[~positive]).mean() - prior * np.logaddexp(0, z[positive]).mean()

    def risk(t):
        """What a step goes down: the risk, or where its negative part is below 0, that part upwards."""
        pos = prior * np.logaddexp(0, -(x[positive] @ t)).mean()
        return pos + negative(t) if negative(theta) >= 0 else -negative(t)

    for k in range(1, steps + 1):
        g = np.array([(risk(theta + e) - risk(theta - e)) / 2e-6 for e in 1e-6 * np.eye(len(theta))])
        g[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        theta = theta - 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    # The bias begins where its derivative is 0 but for rounding, which Adam's first steps enlarge: so the risks are compared, not each weight.
    fitted = np.r_[w[:40][use], b]
    start = np.r_[np.zeros(use.sum()), np.log(prior / (1 - prior))]
    total = lambda t: prior * np.logaddexp(0, -(x[positive] @ t)).mean() + max(0, negative(t))
    assert abs(total(fitted) - total(theta)) < 0.02 * (total(start) - total(theta))
    assert np.allclose(fitted[:-1], theta[:-1], atol=0.02)


def test_scores_do_not_hang_on_the_column_names(spark):
    d = spark.createDataFrame([(1, "you idiot", 0.25)], "doc_id long, text string, score double")
    m = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    [r] = toxicity.score(d, m, out="p").collect()
    assert r.score == 0.25 and abs(r.p - m.prior) < 1e-9
    [r] = toxicity.score(d, m).collect()  # as the docstring says: a column named like the result is replaced
    assert abs(r.score - m.prior) < 1e-9
