import numpy as np

from palaver.llm import nndescent


def brute(rows):
    """{id: (n_links, component)} of (id, vector, label)."""
    good = [(i, np.array(v, float), g) for i, v, g in rows if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, links = {i: i for i, _, _ in rows}, {i: set() for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a, g) in enumerate(good):
        for j, b, h in good[:n]:
            if i != j and g == h and len(a) == len(b) and (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) >= 0.93:
                links[i].add(j)
                links[j].add(i)
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(links[i]), find(i)) for i in root}


def test_clusters_pairs_and_a_dense_group(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label, n in ((0, 1500), (1, 300), (2, 40)):
        x = rng.standard_normal((n, 32))
        x[1::7] = x[0::7][: len(x[1::7])] + 0.1 * rng.standard_normal((len(x[1::7]), 32))
        if label == 0:
            x[:700] = rng.standard_normal(32) + 0.12 * rng.standard_normal((700, 32))
        rows += [(len(rows) + k, [float(v) for v in a], label) for k, a in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute([(i, list(np.array(v, np.float32).astype(float)), g) for i, v, g in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(d).collect()}
    assert got == want


def test_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [1.0, float("nan")], 1), (8, [float("inf"), 0.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (12, [1e30, 0.0], 1), (2, [2.0, 0.0], 1)]
    d = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, id int")
    out = nndescent.near_duplicates(d).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 12: (2, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)}}
    null = nndescent.near_duplicates(spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in null] == [(0, None, True)] * 2


def test_empty_table(spark):
    assert nndescent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_isolated_pairs_among_thousands_of_buckets(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6_000, 24))
    x[3_000:3_300] = x[:300] + 0.37 * rng.standard_normal((300, 24))  # pairs of cosine 0.94 or so
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = {(i, i + 3_000) for i in range(300) if x[i] @ x[i + 3_000] >= 0.93}
    d = spark.createDataFrame([(i, [float(a) for a in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    v = nndescent.checkpoint(nndescent.unit_vectors(d))
    got = {(r.u, r.v) for r in nndescent.descend(v, nndescent.tables_of(v, nndescent.TABLES, 0, block=2)).where("cos >= 0.9").collect()}  # buckets of 12 bits
    assert len(pairs) > 100
    assert len(pairs & got) >= 0.95 * len(pairs)  # the tables alone bring three quarters


def test_groups_whose_lists_are_full_still_meet(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((5, 16))
    rows = []
    for b in base:
        other = b + 0.3 * rng.standard_normal(16)
        other = b / np.linalg.norm(b) * 0.94 + (other - (other @ b) / (b @ b) * b) / np.linalg.norm(other - (other @ b) / (b @ b) * b) * 0.34
        rows += [b] * 30 + [other] * 30  # copies fill the lists; the two groups link
    d = spark.createDataFrame([(i, [float(a) for a in r], 0) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(d).collect()}
    assert got == brute([(i, list(map(float, r)), 0) for i, r in enumerate(rows)])


def test_audit_sees_missing_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 32))
    x[:300] = x[0]
    x[350:] = x[300:350]
    d = spark.createDataFrame([(i, [float(a) for a in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    v = nndescent.checkpoint(nndescent.unit_vectors(d))
    assert nndescent.audit(v, spark.createDataFrame([(i, 299) for i in range(300)], "id long, n_links long")) < nndescent.RECALL
    assert nndescent.audit(v, spark.createDataFrame([(i, 299 if i < 300 else 1) for i in range(400)], "id long, n_links long")) == 1


def test_labels_are_compared_in_full_when_the_tries_run_out(spark, monkeypatch):
    none = spark.createDataFrame([], "u long, v long, cos double")
    monkeypatch.setattr(nndescent, "tables_of", lambda *a, **k: none)
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), 1.0 * (i % 3)], i % 2) for i in range(40)] + [(40, [1.0, 0.0], 0), (41, [2.0, 0.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = nndescent.near_duplicates(d, tables=1, most_tries=1).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute(rows)
    assert {r.audited_recall for r in out} == {1.0}
