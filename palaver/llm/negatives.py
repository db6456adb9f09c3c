"""Hard-negative mining by a vantage-point tree over norm-augmented vectors.

A further component sqrt(M^2 - |x|^2), M the greatest norm, puts all vectors at one norm; an anchor q gets 0 there. Then
d(q, x)^2 = |q|^2 + M^2 - 2 <q, x>: a higher score is a lesser distance, and a window of scores an annulus around the anchor.

The tree's vantage points and radii are fitted on about ``SAMPLE`` rows; every row is indexed by it, and each leaf keeps the least and greatest
distance of all its rows to each vantage point above it. By the triangle inequality these bound the scores that a leaf can hold for an
anchor, so no leaf is left out that could matter, and results are exact for scores below 2^53. An anchor visits leaves nearest first inside its
annulus, in two waves: the ``FIRST`` nearest ones, then, of the others, those that can still beat the k-th best row found so far.

Leaves and anchors meet in blocks: a leaf's rows by ``LEAF`` x 4 (so a vector that a third of all rows hold is no one group), anchors by ``BLOCK``.
The tree that all tasks get has at most 2^``DEPTH`` leaves. In high dimensions, where distances are alike, most anchors visit most leaves: a
stated query set against all rows, in blocks.

Cases: rows with a null id, label or vector or with null or non-finite components take no part; shorter vectors count as if zeros followed; rows
that repeat an id are rows of their own (an anchor's copy is one of its other rows, a repeated anchor answers twice); equal scores go by id, then label;
an anchor without other rows of its label, or without rows in a window, gives no rows there; an empty table gives an empty result; extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.common import checkpoint, give_back, lean, table

SAMPLE = 8_192
LEAF = 512
DEPTH = 12
BLOCK = 2_048
FIRST = 4
SCALE = 256.0


@dataclass
class Tree:
    """A full binary tree as arrays: node i's children are 2i+1 (up to the radius from its point) and 2i+2. lo and hi: by leaf and level."""

    depth: int
    points: np.ndarray
    radius: np.ndarray
    norm2: float
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None
    parts: np.ndarray | None = None

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))])

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distances to the vantage points above."""
        node, x = np.zeros(len(x), np.int64), self.augmented(x)
        path = np.zeros((len(x), self.depth))
        for level in range(self.depth):
            path[:, level] = np.sqrt(((x - self.points[node]) ** 2).sum(axis=1))
            node = 2 * node + 1 + (path[:, level] > self.radius[node])
        return node - ((1 << self.depth) - 1), path

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that each leaf can hold for each anchor."""
        n, leaves = len(q), 1 << self.depth
        own = (q * q).sum(axis=1)[:, None]
        near, far = np.zeros((n, leaves)), np.full((n, leaves), math.inf)
        d = np.sqrt(np.maximum(own + self.norm2 - 2 * q @ self.points[:, :-1].T, 0)) if self.depth else None
        for level in range(self.depth):
            at = ((np.arange(leaves) + leaves) >> (self.depth - level)) - 1
            v = d[:, at]
            near = np.maximum(near, np.maximum(v - self.hi[:, level], self.lo[:, level] - v))
            far = np.minimum(far, v + self.hi[:, level])
        slack = 1e-6 * (own + self.norm2) + 1
        low = (own + self.norm2 - np.minimum(far, 1e154) ** 2) / 2 - slack
        high = (own + self.norm2 - near**2) / 2 + slack
        high[:, self.parts == 0] = -math.inf  # leaves without rows
        return low, high


def fit(sample: np.ndarray, norm2: float, rows: int, leaf: int = LEAF, depth: int = DEPTH) -> Tree:
    """A tree whose leaves hold about ``leaf`` of so many rows, fitted on a sample of them: radii are medians, vantage points spread widest."""
    depth = min(depth, max(0, math.ceil(math.log2(max(1, rows) / leaf))))
    nodes = (1 << depth) - 1
    t = Tree(depth, np.zeros((nodes, sample.shape[1] + 1)), np.full(nodes, math.inf), norm2)
    sets = {0: t.augmented(sample)}
    for i in range(nodes):
        x = sets.pop(i, None)
        if x is None or len(x) < 2:
            continue  # rows go on to the left
        tries = [np.sqrt(((x - x[c]) ** 2).sum(axis=1)) for c in np.linspace(0, len(x) - 1, 5).astype(int)]
        best = max(range(len(tries)), key=lambda c: tries[c].std())
        d = tries[best]
        t.points[i], t.radius[i] = x[np.linspace(0, len(x) - 1, 5).astype(int)[best]], np.median(d)
        sets[2 * i + 1], sets[2 * i + 2] = x[d <= t.radius[i]], x[d > t.radius[i]]
    return t


def _pack(x: np.ndarray) -> list[bytes]:
    """Rows as 16-bit integers where all fit, else as doubles."""
    y = x.astype("<i2") if not len(x) or np.abs(x).max(initial=0) < 1 << 15 else x.astype("<f8")
    return [r.tobytes() for r in y]


def _unpack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), dim))
    for kind in ("<i2", "<f8"):
        at = [i for i, r in enumerate(rows) if len(r) == dim * np.dtype(kind).itemsize]
        if at and dim:
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(-1, dim)
    return out


def vectors(df: DataFrame, anchors: Column, id_col: str, vector_col: str, label_col: str, scale: float) -> tuple[DataFrame, int]:
    """(row, id, label, anchor, q, norm2) of the rows that take part, q the floors of scale x component; and the number of components."""
    v = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where("id is not null and label is not null and v is not null")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    dim = v.agg(F.max(F.size("v"))).first()[0] or 0
    kinds = dict(v.dtypes)

    @lean
    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.zeros((len(b), dim))
            sizes = np.array([len(r) for r in b.column(3)], np.int64)
            x[np.repeat(np.arange(len(b)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = b.column(3).flatten().to_numpy(zero_copy_only=False)
            x = np.floor(x * scale)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(_pack(x), pa.binary()), pa.array((x * x).sum(axis=1))], names=["id", "label", "anchor", "q", "norm2"])

    packed = v.mapInArrow(pack, f"id {kinds['id']}, label {kinds['label']}, anchor boolean, q binary, norm2 double")
    # A number for each row, fixed by writing it down: ids may repeat.
    return checkpoint(packed.withColumn("row", F.monotonically_increasing_id())), dim


def index(v: DataFrame, dim: int, sample: int = SAMPLE, leaf: int = LEAF, depth: int = DEPTH) -> tuple[DataFrame, Tree]:
    """(row, id, label, q, leaf, part) of all rows, and the tree."""
    n, norm2 = v.agg(F.count(F.lit(1)), F.coalesce(F.max("norm2"), F.lit(0.0))).first()
    drawn = v.where(F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(max(1, n))) < sample).orderBy("row").select("q").toPandas()["q"]
    tree = fit(_unpack(pa.array(drawn, pa.binary()), dim), norm2, n, leaf, depth)
    kinds = dict(v.dtypes)
    shared = v.sparkSession.sparkContext.broadcast(tree)

    @lean
    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, path = shared.value.route(_unpack(b.column(3), dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(list(path), pa.list_(pa.float64()))], names=["row", "id", "label", "q", "leaf", "path"])

    rows = checkpoint(v.select("row", "id", "label", "q").mapInArrow(route, f"row bigint, id {kinds['id']}, label {kinds['label']}, q binary, leaf int, path array<double>"))
    leaves, depth = 1 << tree.depth, tree.depth
    ends = [f(F.col("path")[k]).alias(f"{name}{k}") for k in range(depth) for name, f in (("lo", F.min), ("hi", F.max))]
    tree.lo, tree.hi, tree.parts = np.full((leaves, depth), math.inf), np.full((leaves, depth), -math.inf), np.zeros(leaves, np.int32)
    for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *ends).collect():  # at most 2^DEPTH rows
        tree.parts[r["leaf"]] = -(-r["n"] // (4 * leaf))
        for k in range(depth):
            tree.lo[r["leaf"], k], tree.hi[r["leaf"], k] = r[f"lo{k}"], r[f"hi{k}"]
    parts = v.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(tree.parts)], "leaf int, parts int")
    rows = rows.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    return rows.select("row", "id", "label", "q", "leaf", "part"), tree


def nearest(rows: DataFrame, tree: Tree, dim: int, searches: DataFrame, k: int, same: bool, first: int = FIRST, block: int = BLOCK) -> DataFrame:
    """(row, w, score, id, rank): for window w of each search the ``k`` rows of highest score within it whose label is the search's, or isn't.

    searches are (row, label, q, lo, hi): an anchor, and arrays of the least and greatest scores of its windows. The anchor itself is no answer.
    """
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    shared = spark.sparkContext.broadcast(tree)
    blocks = max(1, -(-searches.count() // block))

    def visits(of: DataFrame, wave: int) -> DataFrame:
        @lean
        def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for whole in it:
                for b in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                    low, high = t.scores(_unpack(b.column(2), dim))
                    early, wanted = np.zeros(low.shape, bool), np.zeros(low.shape, bool)
                    los, tops, his = (b.column(i).to_pylist() for i in (3, 4, 5))
                    for w in range(max(map(len, his), default=0)):
                        bound = lambda rows, none: np.array([r[w] if w < len(r) else none for r in rows], float)[:, None]  # noqa: B023, E731
                        lo, top, hi = bound(los, math.inf), bound(tops, math.inf), bound(his, -math.inf)
                        # nearest first from the annulus's inner edge on; the order doesn't hang on what was found
                        line = np.lexsort((-high, -np.minimum(high, hi)), axis=1)[:, :first]
                        inside = (high >= lo) & (low <= hi)
                        own = np.zeros(low.shape, bool)
                        np.put_along_axis(own, line, True, axis=1)
                        early |= own & inside
                        wanted |= inside & (high >= top)
                    wanted = early if wave == 0 else wanted & ~early
                    i, at = np.nonzero(wanted & (t.parts > 0))
                    n = t.parts[at]
                    i, at, part = np.repeat(i, n), np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own = b.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(at.astype(np.int32)), pa.array(part.astype(np.int32))], names=["row", "label", "q", "lo", "top", "hi", "leaf", "part"])

        out = of.select("row", "label", "q", "lo", "top", "hi").mapInArrow(f, f"row bigint, label {kinds['label']}, q binary, lo array<double>, top array<double>, hi array<double>, leaf int, part int")
        return out.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))

    def meet(a: pa.Table, x: pa.Table) -> pa.Table:
        x = x.take(pa.array(np.lexsort((x.column("row").to_numpy(), x.column("label").to_numpy(), x.column("id").to_numpy()))))
        m, n = len(a), len(x)
        found = []
        if m and n:
            s = _unpack(a.column("q"), dim) @ _unpack(x.column("q"), dim).T
            right = (a.column("label").to_numpy()[:, None] == x.column("label").to_numpy()[None, :]) == same
            right &= a.column("row").to_numpy()[:, None] != x.column("row").to_numpy()[None, :]
            tops, his = a.column("top").to_pylist(), a.column("hi").to_pylist()
            for w in range(max(map(len, his))):
                top = np.array([r[w] if w < len(r) else math.inf for r in tops])[:, None]
                hi = np.array([r[w] if w < len(r) else -math.inf for r in his])[:, None]
                key = np.where(right & (s >= top) & (s <= hi), s, -math.inf)
                some = np.flatnonzero(np.isfinite(key).any(axis=1))
                if not len(some):
                    continue
                key = key[some]
                if n > 4 * k and np.abs(s).max() < (1 << 52) / n:  # one number for score and place
                    place = np.argpartition(-(key * n - np.arange(n)), k - 1, axis=1)[:, :k]
                    place.sort(axis=1)
                    place = np.take_along_axis(place, np.argsort(-np.take_along_axis(key, place, 1), axis=1, kind="stable"), 1)
                else:
                    place = np.argsort(-key, axis=1, kind="stable")[:, :k]
                i, j = np.repeat(some, place.shape[1]), place.ravel()
                ok = np.isfinite(np.take_along_axis(key, place, 1).ravel())
                found.append((i[ok], np.full(ok.sum(), w), j[ok]))
        i, w, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else np.zeros((3, 0), np.int64)
        score = s[i, j] if len(i) else np.zeros(0)
        out = pa.table({"row": a.column("row").take(pa.array(i)), "w": pa.array(w.astype(np.int32)), "score": score, "id": x.column("id").take(pa.array(j)), "label": x.column("label").take(pa.array(j)), "other": x.column("row").take(pa.array(j))})
        if m * n > 1_000_000:
            give_back()
        return out

    schema = f"row bigint, w int, score double, id {kinds['id']}, label {kinds['label']}, other bigint"

    def wave(of: DataFrame, number: int) -> DataFrame:
        v = visits(of, number)
        need = v.select(F.col("leaf").alias("to_leaf"), F.col("part").alias("to_part"), F.col("block").alias("to_block")).distinct()
        there = rows.join(need, (F.col("leaf") == F.col("to_leaf")) & (F.col("part") == F.col("to_part")))  # each part once for each block of anchors that comes
        there = there.select("row", "id", "label", "q", "to_leaf", "to_part", "to_block")
        return v.groupBy("leaf", "part", "block").cogroup(there.groupBy("to_leaf", "to_part", "to_block")).applyInArrow(meet, schema)

    line = Window.partitionBy("row", "w").orderBy(F.desc("score"), "id", "label", "other")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)

    s = searches.withColumn("top", F.col("lo"))
    early = checkpoint(best(wave(s, 0)))
    full = early.where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))  # a row a window
    raised = s.join(full, "row", "left").withColumn("top", F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.element_at("kth", i.cast("int")), x))))
    return best(early.drop("rank").unionByName(wave(raised, 1)))


def mine(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = SCALE, sample: int = SAMPLE, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor and each of its ``positives`` best rows of its label: the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent
    of the positive's.
    """
    v, dim = vectors(df, anchors, id_col, vector_col, label_col, scale)
    rows, tree = index(v, dim, sample, leaf, depth)
    a = v.where("anchor").select("row", F.col("id").alias("anchor_id"), "label", "q")
    every = a.withColumns({"lo": F.array(F.lit(-math.inf)), "hi": F.array(F.lit(math.inf))})
    own = checkpoint(nearest(rows, tree, dim, every, positives, True).select("row", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = own.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("p", "positive_score"))).alias("s"))  # ``positives`` at most
    # whole numbers: low s <= 100 x <= high s
    edge = lambda f, of: F.transform("s", lambda x: f(x["positive_score"] * of / F.lit(100.0)).cast("double"))
    searches = a.drop("anchor_id").join(windows, "row").select("row", "label", "q", edge(F.ceil, low).alias("lo"), edge(F.floor, high).alias("hi"))
    found = nearest(rows, tree, dim, searches, negatives, False)
    out = found.join(own.withColumnRenamed("row", "_row"), (F.col("row") == F.col("_row")) & (F.col("p") == F.col("w") + 1)).join(a.select(F.col("row").alias("_a"), "anchor_id"), F.col("row") == F.col("_a"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("positive_score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS a, a.id AS anchor_id, b.r AS b, b.id, b.label, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 50 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id, n.label) AS INT) AS rank, n.id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.a = n.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id, n.label) <= 3
"""
