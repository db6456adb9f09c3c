"""Embedding near-duplicates by NN-descent.

Only vectors of the same label (and length) are compared. Every vector keeps the ``K`` best neighbours known, whatever their cosine.
The lists start from ``TABLES`` random-hyperplane tables: each deals a label's vectors into buckets of about ``BLOCK``, larger ones into
even chunks, and compares within a chunk. Rounds of a neighbours-of-neighbours join then refine the lists until at most ``CHANGE`` of the
entries change. Only then are pairs of ``FLOOR`` or more joined to clusters (vectors whose lists are full of their own cluster get lists of
the best outside it), and every cluster is compared in full, in pairs of blocks, so that no pair within a cluster is missed. An audit compares up to
``AUDIT`` vectors each without a known link, with few and with many with all others by brute force; while fewer than ``RECALL`` of those
that have links know all of theirs, more tables follow, and after ``most_tries`` every label is compared in full, in pairs of blocks.
``n_links`` therefore is exact unless a link joins two clusters that no list connects and the audit's sample misses it.

The lists compare vectors in bytes (a cosine is off by some 0.001, far less than from ``FLOOR`` to the threshold); links are counted in
double precision. Only the audit's vectors are sent to all tasks.

Cases: null ids, labels or vectors, empty and zero vectors and such with null or non-finite components link with nothing; a repeated id is one
vector (the least of its rows), its rows share its figures; ties don't matter, as every link counts; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.common import BROADCAST_ROWS, checkpoint, components, if_small, table

THRESHOLD = 0.93
FLOOR = 0.85
K = 8
BLOCK = 256
TABLES = 8
#: Rounds end when at most this share of the lists' entries is new.
CHANGE = 0.001
AUDIT = 512
RECALL = 0.995


def unit_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, dim, unit) of the vectors that can link: unit is the vector over its norm, in doubles."""
    v = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and label is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(fine).withColumn("top", F.array_max(F.transform("v", lambda x: F.abs(x)))).where("top > 0")
    v = v.withColumn("v", F.transform("v", lambda x: x / F.col("top")))  # no square overflows
    v = v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    v = v.groupBy("id").agg(F.min(F.struct("label", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))).alias("s"))
    return v.select("id", "s.label", F.size("s.unit").alias("dim"), "s.unit")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.array(pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False), float).reshape(-1, dim)


def _signs(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Quantised vectors as unit rows."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantised(v: DataFrame) -> DataFrame:
    """(id, label, dim, q, own): q is the vector in bytes, which puts a cosine off by some 0.001; rows with the same own aren't compared."""

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            q = [np.rint(x * (127 / np.abs(x).max())).astype(np.int8).tobytes() for x in (np.asarray(u.values) for u in b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(q, pa.binary())], names=["id", "label", "dim", "q"])

    kinds = dict(v.dtypes)
    return v.select("id", "label", "dim", "unit").mapInArrow(f, f"id {kinds['id']}, label {kinds['label']}, dim int, q binary").withColumn("own", F.col("id"))


def tables_of(v: DataFrame, n: int, seed: int, block: int = BLOCK, k: int = K) -> DataFrame:
    """(u, v, cos), u < v: the k best of each vector in each chunk of ``n`` tables of random-hyperplane buckets, whatever their cosine."""

    def codes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            t = pa.Table.from_batches([b])
            rows = []
            for dim in np.unique(t.column("dim").to_numpy()):
                own = t.filter(pc.equal(t.column("dim"), int(dim)))
                planes = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), n * 30))
                bits = (_signs(own.column("q"), int(dim)) @ planes > 0).reshape(len(own), n, 30)
                code = (bits * (1 << np.arange(30))).sum(axis=2)
                rows.append(own.append_column("codes", pa.array(list(code), pa.list_(pa.int64()))))
            if rows:
                yield from pa.concat_tables(rows).to_batches()

    v = v if "q" in v.columns else quantised(v)
    schema = ", ".join(f"{c} {t}" for c, t in v.dtypes)
    few = v.groupBy("label", "dim").count().select(F.col("label").alias("_label"), F.col("dim").alias("_dim"), F.greatest(F.lit(0), F.least(F.lit(30), F.round(F.log2(F.col("count") / block)))).cast("int").alias("bits"))
    # A label's size says how many bits of the code make its buckets.
    rows = v.mapInArrow(codes, f"{schema}, codes array<bigint>").join(if_small(few), (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")))
    rows = rows.select("id", "label", "dim", "q", "own", "bits", F.posexplode("codes").alias("t", "code")).withColumn("bucket", F.expr("code & (shiftleft(1L, bits) - 1)")).drop("code", "bits")
    sizes = checkpoint(rows.groupBy("label", "dim", "t", "bucket").count().where(F.col("count") > 2 * block))
    rows = rows.join(if_small(sizes), ["label", "dim", "t", "bucket"], "left").withColumn("chunk", F.pmod(F.xxhash64("id", "t"), F.coalesce(F.ceil(F.col("count") / (2 * block)), F.lit(1))))

    def compare(t: pa.Table) -> pa.Table:
        x, ids = _signs(t.column("q"), t.column("dim")[0].as_py()), t.column("id").to_numpy()
        own = np.unique(t.column("own").to_numpy(), return_inverse=True)[1]
        c = np.where(own[:, None] == own[None, :], np.float32(-2), x @ x.T)
        best = np.argpartition(-c, min(k, len(c)) - 1, axis=1)[:, :k]
        a = np.repeat(np.arange(len(c)), best.shape[1])
        b = best.ravel()
        keep = c[a, b] > -2
        a, b = a[keep], b[keep]
        return pa.table({"u": np.minimum(ids[a], ids[b]), "v": np.maximum(ids[a], ids[b]), "cos": np.minimum(c[a, b], 1.0).astype(float)})

    kind = dict(v.dtypes)["id"]
    return rows.groupBy("label", "dim", "t", "bucket", "chunk").applyInArrow(compare, f"u {kind}, v {kind}, cos double").groupBy("u", "v").agg(F.max("cos").alias("cos"))


def _lists(rows: DataFrame, k: int) -> DataFrame:
    """(u, v, cos, new, rank, worst): the k best of each u; a pair that was there already isn't new. Ties fall by a hash.

    worst is what an entry has to exceed: a full list's least cosine, else -2.
    """
    one = rows.repartition("u").groupBy("u", "v").agg(F.max("cos").alias("cos"), F.min("new").alias("new"))
    line = Window.partitionBy("u").orderBy(F.desc("cos"), F.xxhash64("u", "v"), "v")
    best, own = one.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k), Window.partitionBy("u")
    return checkpoint(best.withColumn("worst", F.when(F.count(F.lit(1)).over(own) >= k, F.min("cos").over(own)).otherwise(-2.0)))


def descend(v: DataFrame, edges: DataFrame, via: DataFrame | None = None, k: int = K, change: float = CHANGE) -> DataFrame:
    """(u, v, cos), u < v: the pairs of the lists of k best, refined from edges by neighbours-of-neighbours joins until hardly an entry changes.

    A vector meets its list, its ``via`` and, as far as 2 k places (3 k with ``via``) go, those that list it (new ones first); pairs of what
    meets at a vector, one of them new there, are tried for the lists of both.
    """
    v = v if "q" in v.columns else quantised(v)
    kind = dict(v.dtypes)["id"]
    turned = edges.select("u", "v", "cos").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos"))
    lists = _lists(turned.withColumn("new", F.lit(True)), k)
    total, changed, turn = lists.count(), 1 << 62, 0
    size = v.count()
    blocks = max(1, size // 512)

    def compare(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        t = t.take(pa.array(np.argsort(mids := np.unique(t.column("mid").to_numpy(), return_inverse=True)[1], kind="stable")))
        mids = np.sort(mids)
        names, at = np.unique(t.column("nb").to_numpy(), return_inverse=True)
        own = np.unique(t.column("own").to_numpy(), return_inverse=True)[1]
        x, fresh, worst = _signs(t.column("q"), dim), t.column("new").to_numpy(), t.column("worst").to_numpy()
        first = np.searchsorted(mids, np.arange(mids[-1] + 2))
        out = []
        for i in range(0, len(first) - 1, 256):
            starts, ends = first[i : i + 256], first[i + 1 : i + 257]
            starts = starts[: len(ends)]
            place = starts[:, None] + np.arange((ends - starts).max())[None, :]
            there = place < ends[:, None]
            place = np.where(there, place, 0)
            y = x[place]
            c = np.minimum(y @ y.transpose(0, 2, 1), 1)
            good = there[:, :, None] & there[:, None, :] & (fresh[place][:, :, None] | fresh[place][:, None, :])
            good &= (own[place][:, :, None] != own[place][:, None, :]) & (c > worst[place][:, :, None] + 1e-6)
            m, p, q = np.nonzero(good)
            out.append((at[place[m, p]], at[place[m, q]], c[m, p, q]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        one = np.unique(a.astype(np.int64) * len(names) + b, return_index=True)[1]  # a pair once
        a, b, c = a[one], b[one], c[one]
        o = np.lexsort((-c, a))
        a, b, c = a[o], b[o], c[o]
        best = np.arange(len(a)) - np.searchsorted(a, a) < k  # more than k can't stay in a list
        return pa.table({"u": names[a[best]], "v": names[b[best]], "cos": c[best].astype(float)})

    while changed > change * total:
        # own list and via, at most k of each, then those that list it; a task keeps no more of a vector's rows than can stay
        met = lists.select(F.col("u").alias("mid"), F.col("v").alias("nb"), "new", F.lit(0).alias("kind"))
        met = met.unionByName(lists.select(F.col("v").alias("mid"), F.col("u").alias("nb"), "new", F.lit(2).alias("kind")))
        if via is not None:
            met = met.unionByName(via.select(F.col("u").alias("mid"), F.col("v").alias("nb"), F.lit(False).alias("new"), F.lit(1).alias("kind")))
        line = Window.partitionBy("mid").orderBy("kind", F.desc("new"), F.xxhash64(F.lit(turn), "mid", "nb"), "nb")
        met = met.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= (2 if via is None else 3) * k)
        met = met.groupBy("mid", "nb").agg(F.max("new").alias("new"))
        met = met.withColumn("any", F.max("new").over(Window.partitionBy("mid"))).where("any").drop("any")
        worst = lists.where("rank = 1").select(F.col("u").alias("nb"), "worst")
        worst = F.broadcast(worst) if size <= BROADCAST_ROWS else worst  # a row a vector at most
        state = v.select(F.col("id").alias("nb"), "dim", "q", "own").join(worst, "nb", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
        rows = met.join(state, "nb").withColumn("block", F.pmod(F.xxhash64("mid"), F.lit(blocks)))
        found = rows.groupBy("dim", "block").applyInArrow(compare, f"u {kind}, v {kind}, cos double")
        lists = _lists(lists.select("u", "v", "cos", F.lit(False).alias("new")).unionByName(found.withColumn("new", F.lit(True))), k)
        total, changed = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("new").cast("int")), F.lit(0))).first()
        turn += 1
    return lists.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cos").groupBy("u", "v").agg(F.max("cos").alias("cos"))


def clusters_of(v: DataFrame, edges: DataFrame, tables: int, seed: int, k: int = K, floor: float = FLOOR) -> DataFrame:
    """(id, cluster): what pairs of floor or more connect.

    Where a list is full of its own cluster, links that leave the cluster have no place in it; such vectors get lists of the k best
    outside their cluster, until these connect no more clusters.
    """
    edges = checkpoint(edges)
    q = v if "q" in v.columns else quantised(v)
    turned = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos"))
    full = checkpoint(turned.where(F.col("cos") >= floor).groupBy("u").count().where(F.col("count") >= k).select("u"))
    via = turned.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cos"), F.xxhash64("u", "v"), "v"))).where(F.col("rank") <= k)
    via = checkpoint(via.join(full, "u", "left_semi").join(full.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v"))
    near, out = edges.where(F.col("cos") >= floor).select("u", "v"), None
    while True:
        clusters = checkpoint(components(near, "u", "v").select(F.col("node").alias("id"), F.col("component_id").alias("cluster")))
        rest = q.join(full.withColumnRenamed("u", "id"), "id", "left_semi").drop("own").join(clusters.withColumnRenamed("cluster", "own"), "id")
        several = rest.groupBy("label", "dim").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo != hi").select("label", "dim")
        rest = checkpoint(rest.join(several, ["label", "dim"], "left_semi").select("id", "label", "dim", "q", "own"))
        if rest.isEmpty():
            return clusters
        out = descend(rest, tables_of(rest, tables, seed, k=k), via, k)
        more = checkpoint(out.where(F.col("cos") >= floor).select("u", "v"))
        if more.isEmpty():
            return clusters
        near = checkpoint(near.unionByName(more))


def links_within(v: DataFrame, clusters: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, n_links, root) per pair of blocks of a cluster: links in it, and the least id that they reach there."""
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).cast("int").alias("n"))
    c = clusters.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    c = c.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("id", "cluster", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = c.join(v.select("id", "dim", "unit"), "id")

    def compare(t: pa.Table) -> pa.Table:
        x, ids, own = _matrix(t.column("unit"), t.column("dim")[0].as_py()), t.column("id").to_numpy(), t.column("own").to_numpy()
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        counted = linked if t.column("i")[0].as_py() == t.column("j")[0].as_py() else linked & (own[:, None] != own[None, :])
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = rank.copy()
        while True:  # the least rank spreads over links
            low = np.minimum(root, np.where(linked, root[None, :], len(ids)).min(axis=1, initial=len(ids)))
            if (low == root).all():
                break
            root = low
        return pa.table({"id": ids, "n_links": counted.sum(axis=1), "root": ids[order][root]})

    kind = dict(v.dtypes)["id"]
    return rows.groupBy("cluster", "i", "j").applyInArrow(compare, f"id {kind}, n_links bigint, root {kind}")


def audit(v: DataFrame, found: DataFrame, threshold: float = THRESHOLD, most: int = AUDIT) -> float:
    """The share of vectors whose links are all known, of those that have any; the least of that for few links (to ``K``) and for more.

    Some ``most`` vectors each without a known link, with few and with more are compared with all rows, and count for as many as they stand for.
    """
    v = v.join(found.select("id", "n_links"), "id", "left").withColumn("known", F.coalesce("n_links", F.lit(0))).drop("n_links")
    stratum = F.when(F.col("known") == 0, 0).when(F.col("known") <= K, 1).otherwise(2)
    sizes = {r["s"]: r["count"] for r in v.groupBy(stratum.alias("s")).count().collect()}
    if not sizes:
        return 1.0
    share = F.element_at(F.array(*[F.lit(1e12 * most / sizes.get(s, 1)) for s in range(3)]), stratum + 1)
    drawn = v.withColumn("s", stratum).where(F.pmod(F.xxhash64(F.lit("audit"), "id"), F.lit(10**12)) < share).toPandas()
    if not len(drawn):
        return 1.0
    shared = v.sparkSession.sparkContext.broadcast((drawn["id"].to_numpy(), drawn["label"].to_numpy(), drawn["dim"].to_numpy(), list(drawn["unit"])))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, dims, units = shared.value
        for b in it:
            t = pa.Table.from_batches([b])
            for dim in np.unique(t.column("dim").to_numpy()):
                own = t.filter(pc.equal(t.column("dim"), int(dim)))
                at = np.flatnonzero(dims == dim)
                if len(at):
                    near = np.stack([units[i] for i in at]) @ _matrix(own.column("unit"), int(dim)).T >= threshold
                    near &= (labels[at][:, None] == own.column("label").to_numpy()[None, :]) & (ids[at][:, None] != own.column("id").to_numpy()[None, :])
                    yield pa.record_batch({"id": pa.array(ids[at]), "truth": pa.array(near.sum(axis=1).astype(np.int64))})

    schema = f"id {dict(v.dtypes)['id']}, truth bigint"
    truth = {r["id"]: r["truth"] for r in v.mapInArrow(count, schema).groupBy("id").agg(F.sum("truth").alias("truth")).where("truth > 0").collect()}
    drawn["truth"] = drawn["id"].map(truth).fillna(0)
    drawn["weight"] = drawn["s"].map({s: sizes[s] / n for s, n in drawn["s"].value_counts().items()})
    linked = drawn[drawn["truth"] > 0]
    shares = [float((g["weight"] * (g["known"] >= g["truth"])).sum() / g["weight"].sum()) for _, g in linked.groupby(linked["truth"] > K)]
    return min(shares, default=1.0)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, floor: float = FLOOR, tables: int = TABLES, most_tries: int = 4) -> DataFrame:
    """(id, n_links, component_id, kept) per row of df."""
    v = checkpoint(unit_vectors(df, id_col, vector_col, label_col))
    q = checkpoint(quantised(v))
    edges, recall = None, 0.0
    for attempt in range(most_tries):
        new = tables_of(q, tables << attempt, attempt)
        edges = checkpoint(descend(q, new if edges is None else edges.unionByName(new)))
        clusters = clusters_of(q, edges, tables << attempt, attempt, floor=floor)
        parts = checkpoint(links_within(v, clusters, threshold))
        found = checkpoint(parts.groupBy("id").agg(F.sum("n_links").alias("n_links")))
        recall = audit(v, found, threshold)
        if recall >= RECALL:
            break
    else:  # what the lists don't reach, every label compared in full does
        parts = checkpoint(links_within(v, v.select("id", F.struct("label", "dim").alias("cluster")), threshold))
        found = checkpoint(parts.groupBy("id").agg(F.sum("n_links").alias("n_links")))
        recall = audit(v, found, threshold)
    joined = components(parts.select("id", "root"), "id", "root")
    out = df.select(F.col(id_col).alias("id")).join(found, "id", "left").join(joined, F.col("id") == F.col("node"), "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"), F.lit(recall).alias("audited_recall"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  coalesce(e.vec_id = coalesce(c.component_id, e.vec_id), true) AS kept, 1.0::DOUBLE AS audited_recall
FROM embeddings e LEFT JOIN c ON e.vec_id = c.node LEFT JOIN n ON e.vec_id = n.a
"""
