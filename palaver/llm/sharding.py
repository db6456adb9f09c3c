"""Sharding by a hierarchical weighted hash tree.

A ``Tree`` has regions, racks in regions and shards in racks, each with a weight of its own. A row descends level by level: at every level
each child draws -ln(u) / weight, u a hash of the row's key and the child's name, and the least draw wins. So a child gets rows in
proportion to its weight among its siblings, a sibling whose weight rises only takes rows, and a change of a shard's weight moves rows within
its rack only, of a rack's within its region, of a region's between regions.

A shard that is ``added`` to a rack brings weight that the draws above it didn't have. It competes with a draw of its own, at the level of the
regions, against the draw of the region that won: where its own is less, the row goes straight to the new shard, else nothing changes. By
the law of the least of exponential draws the shares are those of the weights, and rows move into the new shard only. Were the added weight
given to region and rack instead, rows that enter the region would fall to its other racks too.

Slots number the rows of a shard from 0. Rows meet by (shard, ``BINS`` bins of a hash), so that no task sees a shard whole; bins get
their offsets from running sums over at most shards x ``BINS`` counts, which is also what is broadcast. Equal rows are counted before the shuffle.

Cases: a null key is a key like others; a null text has no bytes, size 1 and the checksum of nothing, 0; rows that repeat a key share its
shard and have slots of their own; within a bin slots follow key, checksum and size, and equal rows are interchangeable; an empty table gives
an empty result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.common import checkpoint, table

BINS = 1024


@dataclass(frozen=True)
class Shard:
    number: int
    weight: float = 1.0


@dataclass(frozen=True)
class Rack:
    shards: tuple[Shard, ...]
    weight: float


@dataclass(frozen=True)
class Region:
    racks: tuple[Rack, ...]
    weight: float


@dataclass(frozen=True)
class Tree:
    """Regions by position, racks by position in their region, shards by number; ``added``: (region, rack, shard) that came later."""

    regions: tuple[Region, ...]
    added: tuple[tuple[int, int, Shard], ...] = ()

    def grown(self, region: int, rack: int, shard: Shard) -> Tree:
        """The tree with one more shard, which takes rows only into itself."""
        if any(shard.number == n for n in self.numbers()):
            raise ValueError(f"there is a shard {shard.number} already")
        self.regions[region].racks[rack]
        return replace(self, added=(*self.added, (region, rack, shard)))

    def numbers(self) -> list[int]:
        return [s.number for g in self.regions for r in g.racks for s in r.shards] + [s.number for _, _, s in self.added]

    def shares(self) -> dict[int, float]:
        """What part of the keys each shard is to get."""
        total = sum(g.weight for g in self.regions) + sum(s.weight for _, _, s in self.added)
        out = {}
        for g in self.regions:
            for r in g.racks:
                for s in r.shards:
                    out[s.number] = g.weight / total * r.weight / sum(x.weight for x in g.racks) * s.weight / sum(x.weight for x in r.shards)
        return out | {s.number: s.weight / total for _, _, s in self.added}


def even_tree(regions: int = 2, racks: int = 2, shards: int = 4) -> Tree:
    """A tree of equal shards, numbered along."""
    rack = lambda g, r: Rack(tuple(Shard((g * racks + r) * shards + s) for s in range(shards)), float(shards))
    return Tree(tuple(Region(tuple(rack(g, r) for r in range(racks)), float(racks * shards)) for g in range(regions)))


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """An exponential draw of the rate weight by key and node; the name begins with its level, so levels draw apart."""
    u = (F.shiftrightunsigned(F.xxhash64(name, key.cast("string")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) / weight


def _winner(draws: Sequence[Column], values: Sequence[Column]) -> Column:
    """(draw, value) of the least draw; at one draw of the least value."""
    return F.array_min(F.array(*[F.struct(d.alias("draw"), v.alias("value")) for d, v in zip(draws, values, strict=True)]))


def _level(key: Column, named: Column, weights: Sequence[Sequence[float]], at: Column) -> Column:
    """The child (by position) that wins below node ``at`` of the level above; weights by node and child, of children that lack 0."""
    most = max(map(len, weights))
    held = F.array(*[F.array(*[F.lit(float(w)) for w in [*ws, *[0.0] * (most - len(ws))]]) for ws in weights])
    w = F.element_at(held, at + 1)
    child = F.array(*[F.struct(F.when(w[i] > 0, _draw(key, F.concat(named, F.lit(f"/{i}")), w[i])).otherwise(math.inf).alias("draw"), F.lit(i).alias("value")) for i in range(most)])
    return F.array_min(child)["value"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The number of the key's shard."""
    if any(x.weight <= 0 for g in tree.regions for x in (g, *g.racks, *(s for r in g.racks for s in r.shards))) or any(s.weight <= 0 for _, _, s in tree.added):
        raise ValueError("weights are more than 0")
    names = [f"region/{i}" for i in range(len(tree.regions))]
    region = _winner([_draw(key, F.lit(n), F.lit(g.weight)) for n, g in zip(names, tree.regions, strict=True)], [F.lit(i) for i in range(len(names))])

    racks = [g.racks for g in tree.regions]
    first = [sum(len(r) for r in racks[:i]) for i in range(len(racks))]  # a rack's position among all
    flat = [r for rs in racks for r in rs]

    def descend(g: Column) -> Column:
        rack = _level(key, F.concat(F.lit("rack/"), g.cast("string")), [[r.weight for r in rs] for rs in racks], g)
        place = F.element_at(F.array(*map(F.lit, first)), g + 1) + rack
        shard = _level(key, F.concat(F.lit("shard/"), place.cast("string")), [[s.weight for s in r.shards] for r in flat], place)
        most = max(len(r.shards) for r in flat)
        numbers = F.array(*[F.lit(n) for r in flat for n in [*(s.number for s in r.shards), *[-1] * (most - len(r.shards))]])
        return F.element_at(numbers, place * most + shard + 1)

    if not tree.added:
        return descend(region["value"])
    late = _winner([_draw(key, F.lit(f"added/{g}/{r}/{s.number}"), F.lit(s.weight)) for g, r, s in tree.added], [F.lit(s.number) for _, _, s in tree.added])
    return F.when(late["draw"] < region["draw"], late["value"]).otherwise(descend(region["value"]))


def assign(df: DataFrame, key: str, tree: Tree, out: str = "shard") -> DataFrame:
    """df with the shard of each row."""
    return df.withColumn(out, shard_of(F.col(key), tree))


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], bins: int = BINS, out: str = "slot") -> DataFrame:
    """rows with the number of each within its shard, from 0 and without gaps; ``order`` and shard are all that rows are told apart by."""
    same = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    same = checkpoint(same.withColumn("_bin", F.pmod(F.xxhash64(*order), F.lit(bins)).cast("int")))
    sums = same.groupBy(F.col(shard).alias("_shard"), F.col("_bin").alias("_b")).agg(F.sum("_n").alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.partitionBy("_shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_shard", "_b", before.alias("_from"))  # at most shards x bins rows
    line = Window.partitionBy(shard, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = same.withColumn("_before", F.coalesce(F.sum("_n").over(line), F.lit(0)))
    j = own.join(F.broadcast(offsets), (F.col(shard) == F.col("_shard")) & (F.col("_bin") == F.col("_b")))
    start = F.col("_from") + F.col("_before")
    return j.select(*rows.columns, F.explode(F.sequence(start, start + F.col("_n") - 1)).alias(out))


def place(docs: DataFrame, tree: Tree, then: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) per row; grown_shard is the shard by the tree ``then``, null without one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign(rows, "id", tree)
    rows = rows.withColumn("grown_shard", shard_of(F.col("id"), then) if then else F.lit(None).cast("int"))
    return with_slots(rows, "shard", ["id", "text_crc32", "size"], bins).withColumnRenamed("id", id_col)


def movement(placed: DataFrame) -> DataFrame:
    """(shard, grown_shard, n, bytes) of the rows that the grown tree moves."""
    return placed.where("shard != grown_shard").groupBy("shard", "grown_shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def write(docs: DataFrame, tree: Tree, path: str, id_col: str = "doc_id", files: int = 8) -> None:
    """docs as Parquet files by shard, ``files`` a shard, each ordered by id; the files of a shard are dealt by a hash of whole rows."""
    own = docs.withColumn("shard", shard_of(F.col(id_col), tree))
    own = own.withColumn("_file", F.pmod(F.xxhash64(*docs.columns), F.lit(files)))
    own.repartition(len(tree.numbers()) * files, "shard", "_file").sortWithinPartitions("shard", "_file", id_col).drop("_file").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 in two regions of two racks; the grown tree has a shard 16 in the last rack."""
    tree = even_tree(2, 2, 4)
    out = place(table(spark, sf_dir, "documents"), tree, tree.grown(1, 1, Shard(16)))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
