import numpy as np

from palaver.operators import voices


def test_window_scores_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(voices, "BLOCK", 7, raising=False)
    monkeypatch.setattr(voices, "MOST_CHUNKS", 20, raising=False)  # the list once had a cap; no number of chunks may fail
    rng = np.random.default_rng(3)
    x, p = rng.standard_normal((40, 8)), rng.standard_normal((61, 8))
    names = ["one" if i == 0 else "ab"[i % 2] for i in range(61)]
    w = spark.createDataFrame([(i % 3, i % 2, i, [float(a) for a in r]) for i, r in enumerate(x)], "ep long, label int, win long, emb array<double>")
    q = spark.createDataFrame([(n, [float(a) for a in r]) for n, r in zip(names, p, strict=True)], "name string, emb array<double>")
    got = {(r.win, r.name): (r.ep, r.label, round(r.score, 6)) for r in voices.window_scores(w, q).collect()}
    want = {}
    for i, r in enumerate(x):
        for n in set(names):
            s = sorted((float(r @ c) for c, m in zip(p, names, strict=True) if m == n), reverse=True)[:3]
            want[i, n] = (i % 3, i % 2, round(sum(s) / len(s), 6))
    assert got == want
    assert voices.window_scores(w, q.limit(0)).count() == 0


def test_similarities_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((23, 5))
    d = spark.createDataFrame([(f"n{i:02d}", [float(a) for a in r]) for i, r in enumerate(x)], "name string, emb array<double>")
    want = {(f"n{i:02d}", f"n{j:02d}"): round(float(x[i] @ x[j]), 6) for i in range(23) for j in range(i + 1, 23)}
    for block in (4, 100):
        got = voices.similarities(d, block=block).collect()
        assert len(got) == len(want) and all(abs(r.sim - want[r.a, r.b]) < 2e-6 for r in got)
    assert voices.similarities(d.limit(0)).count() == 0


def test_fold_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(voices, "STRIP", 3, raising=False)
    rng = np.random.default_rng(6)
    u, v = rng.standard_normal((30, 6)), rng.standard_normal((41, 6))
    left = spark.createDataFrame([(i % 2, i, [float(a) for a in r]) for i, r in enumerate(u)] + [(0, 98, None), (0, 99, [None] * 6), (7, 97, [1.0] * 6)], "ep long, label long, emb array<double>")
    right = spark.createDataFrame([(i % 2, f"p{i % 5}", [float(a) for a in r]) for i, r in enumerate(v)] * 2 + [(0, "none", None), (0, "part", [1.0])], "ep long, name string, emb array<double>")
    want = {}
    for i, r in enumerate(u):
        best = sorted(((max(float(r @ c) for j, c in enumerate(v) if j % 2 == i % 2 and j % 5 == k), f"p{k}") for k in range(5)), key=lambda b: (-b[0], b[1]))
        if best[0][0] >= 0.5 and best[0][0] - best[1][0] >= 0.1:
            want[i % 2, i] = (best[0][1], round(best[0][0], 9))
    for block in (4, 7, 1000):
        assert {(r.ep, r.label): (r.into, round(r.sim, 9)) for r in voices.fold(left, right, 0.5, 0.1, block=block).collect()} == want
