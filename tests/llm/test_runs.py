import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from palaver.llm import runs


def brute(words, least=6, times=4):
    """All runs (start, length, period) by comparing words p apart."""
    out, n = {}, len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, times * p) and (i, j + p - i) not in out:
                out[i, j + p - i] = p
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in out.items())


def split(text):
    return (text or "").encode().split()


def row(doc_id, text):
    """What the query says of a document, from the contract."""
    w = split(text)
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    r = brute(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + k for s, k, q in r)]
    best = min(r, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(r), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{k},{q}\n" for s, k, q in r).encode()), sha(b" ".join(kept)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, sf):
    got = sorted(tuple(r) for r in runs.query(spark, sf).select(*COLUMNS).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == sorted(row(d.doc_id, d.text) for d in docs) and any(r[1] for r in got)


def test_pieces_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        pieces = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 6))]
            x = [rng.randrange(3) for _ in range(rng.randint(0, 8))] + unit * rng.randint(1, 9) + [rng.randrange(3) for _ in range(rng.randint(0, 8))]
            pieces.append(np.array(x * rng.choice([1, 1, 5])))
        got = list(zip(*(c.tolist() for c in runs.runs_of(pieces)), strict=True))
        assert got == [(k, *r) for k, x in enumerate(pieces) for r in brute(x.tolist())]


def test_common_extensions():
    rng = np.random.default_rng(3)
    x = np.append(rng.integers(0, 2, 300), 5)
    e = runs.Extensions(x)
    i, k = np.array([(i, k) for i in range(0, 300, 7) for k in range(300) if i != k]).T
    want = [next(n for n in range(301) if max(a, b) + n == 300 or x[a + n] != x[b + n]) for a, b in zip(i, k, strict=True)]
    assert e.ahead(i, k).tolist() == want


def test_edges_and_general_form(spark):
    long = " ".join(["a b c"] * 3000 + ["x"] * 5000 + [str(i % 7919) for i in range(20_000)])
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "go go go go go go"), (4, "go go go go go go"), (4, "go go go go go"), (5, long), (5, long), (6, "é é " * 9), (-7, "a b a b a b a b stop a b a b a b a c")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("clash"), "n_runs": F.lit(1), "runs": F.lit(2)})
    got = runs._found(d, "doc_id", "text", 6, 4, plant=True, digests=True)
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect() if r.doc_id != 5), key=key) == sorted((row(*r) for r in rows if r[0] != 5), key=key)
    found = {r.text: r for r in runs.find(d.withColumn("doc_id", F.col("text")), "doc_id").withColumnRenamed("doc_id", "text").collect()}
    assert [tuple(x) for x in found[long].runs] == [(0, 9000, 3), (9000, 5000, 1)] and found[long].n_words == 34_000
    assert found[long].collapsed == " ".join(["a b c x", *(str(i % 7919) for i in range(20_000))])
    assert found["go go go go go"].runs == [] and found["go go go go go go"].collapsed == "go" and found[None].collapsed == ""
    assert [tuple(x) for x in found["a b a b a b a b stop a b a b a b a c"].runs] == [(0, 8, 2)]
    assert runs.find(d.limit(0)).count() == 0
