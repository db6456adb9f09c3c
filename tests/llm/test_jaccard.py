import random
import re

from palaver.llm import jaccard


def brute(rows):
    """rows of (id, text) to {id: (sizes, component)} by comparing all pairs that share a shingle."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by: dict = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in pairs:
        x, y = sets[a][1], sets[b][1]
        if 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(sets[a][0]), find(sets[b][0])))
            root[q] = p
    return sorted(((i, len(s), find(i)) for i, s in sets), key=str)


def brute_links(rows):
    """n_links of each row (id, text): other rows with an id and a similar set."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w and i is not None else set())
    by, n = {}, [0] * len(rows)
    for k, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    for a, b in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            n[a] += 1
            n[b] += 1
    return sorted(((i, k) for (i, _), k in zip(rows, n, strict=True)), key=str)


def got_links(df):
    return sorted(((r.doc_id, r.n_links) for r in df.collect()), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(jaccard.query(spark, sf)) == brute(rows)


def test_chains_groups_and_edges(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows, n = [], 0
    for _ in range(150):  # near copies of one text, some within and some below the threshold
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = word()
        rows.append((n := n + 1, " ".join(t)))
    chain = list(base[:60])
    for _ in range(40):  # each step is like the last, the ends are not
        chain[rng.randrange(60)] = word()
        rows.append((n := n + 1, "\t".join(chain).upper()))
    passage = " ".join(word() for _ in range(55))
    for _ in range(80):  # a passage that many share
        rows.append((n := n + 1, passage + " " + " ".join(word() for _ in range(rng.randint(1, 60)))))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, " \n"), (n + 4, "one two"), (n + 5, "ONE  two"), (n + 6, "one two three"), (n + 7, "É x y z é"), (n + 8, "é x y z é"), (n + 9, "a b c d e"), (n + 10, "a b c d e")]
    rng.shuffle(rows)
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    assert got(jaccard.join(d)) == brute(rows)


def test_null_and_repeated_ids(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    d = spark.createDataFrame([(1, a), (1, b), (5, b), (None, a), (7, a), (7, a)], "doc_id long, text string")
    assert sorted(got(jaccard.join(d)), key=str) == sorted([(1, 4, 1), (1, 4, 1), (5, 4, 1), (None, 4, None), (7, 4, 1), (7, 4, 1)], key=str)


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_link_is_counted(spark, monkeypatch):
    """Links within groups of near copies, in one block and in several, of copies, repeated ids and rows without one."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows, n = [word() for _ in range(100)], [], 0
    for _ in range(90):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = word()
        rows.append((n := n + 1, " ".join(t)))
    chain = list(base[:50])
    for _ in range(30):
        chain[rng.randrange(50)] = word()
        rows.append((n := n + 1, " ".join(chain)))
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1].upper()), (n + 3, "one two"), (n + 4, "one two"), (n + 5, None), (n + 6, ""), (None, rows[0][1]), (1, "another text under a known id it is"), (n + 3, rows[0][1]), (1, rows[0][1])]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n_links int").repartition(6)
    assert got_links(jaccard.join(d, links=True)) == brute_links(rows)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    comp = jaccard.links_within.__defaults__
    monkeypatch.setattr(jaccard.links_within, "__defaults__", (*comp[:-1], 16))
    assert got_links(jaccard.join(d, links=True)) == brute_links(rows) and sum(k for _, k in brute_links(rows)) > 1000
    assert jaccard.join(d.limit(0), links=True).count() == 0


def test_links_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got_links(jaccard.query(spark, sf)) == brute_links(rows)
