from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from palaver.llm import negatives

V = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, few=3, low=50, high=95, every=50):
    """The rows of the operator by comparing each anchor with all, as a multiset."""
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)), g) for i, v, g in rows if i is not None and v is not None and g is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v, _ in good), default=0)
    x = np.array([np.pad(v, (0, dim - len(v))) for _, v, _ in good]).reshape(len(good), dim)
    out = Counter()
    for a, (i, _, g) in enumerate(good):
        if i % every:
            continue
        s = x @ x[a]
        line = sorted((k for k in range(len(good)) if k != a), key=lambda k: (-s[k], good[k][0], good[k][2]))
        same, other = [k for k in line if good[k][2] == g], [k for k in line if good[k][2] != g]
        for p in same[:positives]:
            fit = [k for k in other if low * s[p] <= 100 * s[k] <= high * s[p]]
            out.update((i, good[p][0], r + 1, good[k][0], int(s[p]), int(s[k])) for r, k in enumerate(fit[:few]))
    return out


def clustered(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, dim))
    x = centre[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, dim))
    x[: n // 3] = x[0]  # a vector that a third of all rows hold
    x /= np.linalg.norm(x, axis=1, keepdims=True) / rng.uniform(0.5, 1.5, (n, 1))
    return [(k, [float(v) for v in r], int(g)) for k, (r, g) in enumerate(zip(x, rng.integers(0, labels, n), strict=True))]


def test_tree_of_many_leaves_against_brute_force(spark):
    rows = clustered(3_000, 12, 1)
    d = spark.createDataFrame(rows, V)
    got = Counter(map(tuple, negatives.mine(d, F.col("vec_id") % 50 == 0, sample=512, leaf=32).collect()))
    assert got == brute(rows) and len(got) > 100


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = Counter(map(tuple, negatives.query(spark, sf).select(*names).collect()))
    assert got == Counter(c.execute(f"SELECT {', '.join(names)} FROM ({negatives.ORACLE_SQL})").fetchall()) and got


def test_bounds_hold_and_spare_leaves():
    """No score lies outside its leaf's bounds; of clustered vectors, most leaves are shown to be out of reach."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.standard_normal((40, 8)).repeat(50, axis=0) + 0.05 * rng.standard_normal((2000, 8))))
    t = negatives.fit(x[::4], float((x * x).sum(axis=1).max()), len(x), leaf=32)
    leaf, path = t.route(x)
    n = 1 << t.depth
    t.lo = np.array([path[leaf == k].min(axis=0, initial=np.inf) for k in range(n)])
    t.hi = np.array([path[leaf == k].max(axis=0, initial=-np.inf) for k in range(n)])
    t.parts = np.bincount(leaf, minlength=n)
    low, high = t.scores(x[:100])
    s = x[:100] @ x.T
    assert (s <= high[:, leaf]).all() and (s >= low[:, leaf]).all()
    best = np.sort(s, axis=1)[:, -5:][:, :1]
    assert (high >= best).mean() < 0.5


def test_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.0], 2), (3, [0.8, 0.0], 3), (4, [0.8, 0.0], 2), (5, [0.8], 2), (50, [0.5, 0.5], 9), (100, None, 1), (150, [1.0, None], 1), (200, [float("nan"), 1.0], 1)]
    rows += [(250, [1.0, 0.0], None), (None, [0.8, 0.0], 2), (300, [], 2), (350, [1e4, 1.0], 1), (7, [-0.9, 0.3], 1), (8, [-0.7, 0.3], 2), (2, [0.8, 0.0], 2)]
    d = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], V + ", row int, q string, anchor int")
    for leaf in (512, 1):
        assert Counter(map(tuple, negatives.mine(d, F.col("vec_id") % 50 == 0, leaf=leaf).collect())) == brute(rows)
    assert negatives.mine(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(d.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0
