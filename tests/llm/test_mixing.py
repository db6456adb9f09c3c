import hashlib
import math
from collections import defaultdict

from pyspark.sql import functions as F

from palaver.llm import mixing

SCHEMA = "doc_id long, source string, text string, target int, epochs string"


def brute(rows, weight):
    """[(id, source, size)] to {index: copies}: whole epochs, then the least keys up to the nearest word count."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    share = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    goal, open_, left = {}, set(sources), 1.5 * sum(own.values())
    while open_:
        level = left / sum(share[s] for s in open_)
        full = {s for s in open_ if level * share[s] >= 2 * own[s]}
        goal |= {s: 2.0 * own[s] for s in full} or {s: level * share[s] for s in open_}
        left -= sum(goal[s] for s in full)
        open_ = open_ - full if full else set()
    key = lambda i: -math.log((int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight.get(i, 1.0)
    copies = {}
    for s in sources:
        whole, upto = math.floor(goal[s] / own[s]) if own[s] else 0, 0
        for k in sorted((k for k, r in enumerate(rows) if r[1] == s), key=lambda k: (key(rows[k][0]), rows[k][0] is not None, rows[k][0] or 0, rows[k][2])):
            upto += rows[k][2]
            copies[k] = whole + (upto - rows[k][2] / 2 <= goal[s] - whole * own[s])
    return copies, goal, own


def test_nulls_repeats_ties_and_clashing_columns(spark):
    rows = [(i, s, " ".join(["w"] * (i % 9)), 3, "x") for i in range(300) for s in [("a", "b", "é", None)[i % 4]]]
    rows += [(None, "a", "one two", 3, "x")] * 3 + [(7, "b", "one two three", 3, "x")] * 5 + [(900, None, None, 3, "x"), (901, "empty", "", 3, "x"), (902, "a", "x " * 40_000, 3, "x")]
    d = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = mixing.mix(d, keep=("epochs",))
    plain = [(i, s, len((t or "").split())) for i, s, t, *_ in rows]
    copies, goal, own = brute(plain, {})
    want, seen = defaultdict(list), defaultdict(list)
    for k, (i, s, n) in enumerate(plain):
        want[i, s, n].append(copies[k])
    for r in got.collect():
        assert r.source_size == own[r.source] and math.isclose(r.target, goal[r.source]) and r.taken == r.copies * r.size
        seen[r.doc_id, r.source, r.size].append(r.copies)
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}


def test_weights_come_from_quality(spark):
    d = spark.createDataFrame([(i, "a" if i % 2 else "b", "w " * 5, 0, "") for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 3 - 1) for i in range(0, 390)] + [(None, 1), (5, 1), (6, None)], "doc_id long, quality int")
    weighed = mixing.with_quality(d, labels)
    assert weighed.count() == 400
    w = {r.doc_id: r.mix_weight for r in weighed.collect()}
    assert w[5] == 2.0 and w[395] == 1.0 and w[3] == 0.5
    got = {r.doc_id: r.copies for r in mixing.mix(weighed, weight=F.col("mix_weight")).collect()}
    assert got == dict(enumerate(brute([(i, "a" if i % 2 else "b", 5) for i in range(400)], w)[0][i] for i in range(400)))


def test_empty_table_and_one_row(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    [r] = mixing.mix(spark.createDataFrame([(1, None, "a b", 0, "")], SCHEMA)).collect()
    assert (r.size, r.source_size, r.target, r.copies) == (2, 2, 3.0, 2)
    [r] = mixing.mix(spark.createDataFrame([(1, "s", None, 0, "")], SCHEMA)).collect()
    assert (r.size, r.taken, r.target) == (0, 0, 0.0)
