import math
import re
from collections import Counter

from palaver.llm import lmscore


def brute(texts, order=3, back=0.4):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    grams = lambda d: Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1))
    total, n_all, out = sum(map(grams, docs), Counter()), sum(map(len, docs)), []
    for d in docs:
        own, rest, score, hits = grams(d), n_all - len(d), 0.0, [0] * order
        for i in range(len(d)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(d[i - n + 1 : i + 1])
                c, b = total[g] - own[g], total[g[:-1]] - own[g[:-1]] if n > 1 else rest
                if c > 0 and b > 0:
                    score += math.log(back ** (order - n) * c / b)
                    hits[n - 1] += 1
                    break
            else:
                score += math.log(back**order / max(rest, 1))
        out.append((len(d), round(score, 6), hits))
    return out


TEXTS = [None, "", " \n", "a", "A b  c", "a b c d", "x a b c d e a b c", "q\tq q q q", "q q", "é É é", "a b c d", "w " * 5_000, " ".join(f"n{i}" for i in range(3_000)), "w w n1 n2 n3"]


def test_scores_equal_brute_force(spark):
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, block int").repartition(3)
    for size in (200, 1 << 24):
        got = {r.doc_id: (r.n_tokens, round(r.log_score, 6), list(r.hits)) for r in lmscore.score(d, keep=("doc_id", "block"), block_chars=size, buckets=5).collect()}
        assert got == dict(enumerate(brute(TEXTS)))


def test_repeated_rows_nulls_and_empty_table(spark):
    d = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r.n_tokens, r.hits) for r in lmscore.score(d).collect()) == [(2, [1, 1, 0])] * 3
    assert lmscore.score(d.limit(0)).count() == 0
