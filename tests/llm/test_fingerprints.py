import hashlib
import math
import re
from collections import Counter

import xxhash

from palaver.llm import fingerprints


def chained(rows):
    """[(id, text, next text)] by falling id, a null id last."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    return [(i, t, rows[(n + 1) % len(rows)][1]) for n, (i, t) in enumerate(rows)]


def sha(t, after):
    m = len(t) // 3
    return hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = fingerprints.fingerprints(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {i: (len(t), sha(t, n)) for i, t, n in chained(texts.items())}
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want and len(rows) == len(texts)
    prints = {}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
    assert len(set(prints.values())) >= 0.98 * len(prints)
    long = [r for r in rows if r.n_chars >= 200]
    assert sum(r.near_edited for r in long) / len(long) >= 0.25
    assert sum(r.near_next for r in long) / len(long) <= 0.1
    assert sum(r.near_edited > r.near_next for r in long) >= 0.9 * len(long)


def test_edges(spark):
    rows = [(5, "one two three four"), (4, None), (None, "nul id"), (9, "😀" * 7), (9, "é"), (-3, ""), (2, "x" * 100_000), (5, "one two three four")]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bin int")
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprints(d).collect()), key=str)
    assert got == sorted(((i, len(t), sha(t, n)) for i, t, n in chained(rows)), key=str)
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "alone here now")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == sha("alone here now", "alone here now") and one[0].near_next == 1.0


def test_empty_table(spark):
    assert fingerprints.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_scramble(h):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ (h >> 33)) * factor) % (1 << 64)
    return h ^ (h >> 33)


def plain_terms(text):
    return sorted({xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"[^\W_]+", (text or "").lower())})


def plain_print(text, lex):
    """A fingerprint term by term and subset by subset, in whole numbers."""
    t = plain_terms(text)
    out = [f"{xxhash.xxh3_64_intdigest(b''.join(h.to_bytes(8, 'little') for h in t)):016x}"]
    own = [h for h in t if h in lex]
    if own:
        best = max(0, round(math.log2(len(own) / 1.4)))
        for rate in range(max(0, best - 1), best + 2):
            shown = ""
            for i in range(fingerprints.SUBSETS):
                seed = xxhash.xxh3_64_intdigest(f"lexicon {i}".encode())
                drawn = [plain_scramble(h ^ seed) for h in own]
                inside = [d for d in drawn if d < 1 << 64 - rate]  # one of 2^rate terms is in the subset
                shown += f"{sum(map(plain_scramble, inside)) % (1 << 64) % 65535 + 1 if inside else 0:04x}"
            out.append(f"{rate}:{shown}")
    return ".".join(out)


def plain_likeness(a, b):
    if a.split(".")[0] == b.split(".")[0]:
        return 1.0
    x, y = (dict(p.split(":") for p in f.split(".")[1:]) for f in (a, b))
    best = 0.0
    for rate in x.keys() & y.keys():
        pairs = [(x[rate][i : i + 4], y[rate][i : i + 4]) for i in range(0, 4 * fingerprints.SUBSETS, 4)]
        some = [(p, q) for p, q in pairs if (p, q) != ("0000", "0000")]
        if 2 * len(some) >= fingerprints.SUBSETS:
            best = max(best, sum(p == q for p, q in some) / len(some))
    return best


def test_lexicon_fingerprints_and_likeness_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    df = Counter(h for t in texts.values() for h in plain_terms(t))
    lex = {h for h, n in df.items() if n >= 2 and fingerprints.IDF[0] <= math.log(len(texts) / n) <= fingerprints.IDF[1]}
    assert {*fingerprints.lexicon(docs).tolist()} == lex and 100 < len(lex) < len(df)
    rows = {r.doc_id: r for r in fingerprints.query(spark, "/root/testdata/sf0.01").collect()}
    for k, (i, t, after) in enumerate(chained(texts.items())):
        if k % 5 == 0 or len(t) < 100:
            m = len(t) // 3
            own, edited, following = (plain_print(x, lex) for x in (t, t[: len(t) - m] + after[:m], after))
            r = rows[i]
            assert (r.fingerprint, r.edited_fingerprint) == (own, edited)
            assert abs(r.near_edited - plain_likeness(own, edited)) < 1e-9 and abs(r.near_next - plain_likeness(own, following)) < 1e-9


def test_ties_of_ids_across_ranges(spark):
    """Most rows share one id, so that all bounds of the ranges fall on it: every row still has its successor."""
    rows = [(7, f"text number {k:03d} of many") for k in range(300)] + [(1, "first"), (9, "last")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprints(d).collect())
    assert got == sorted((i, len(t), sha(t, n)) for i, t, n in chained(rows))
