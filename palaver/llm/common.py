"""What the operators of this subpackage share: reading tables, cutting lineage, word splitting, graph components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many rows of ids and small numbers are broadcast (some 50 MB).
BROADCAST_ROWS = 1_000_000
#: Words whose hashes or features a task keeps at hand (some 200 bytes each).
CACHED_WORDS = 200_000


class WordHashes(dict):
    """64-bit hashes of words, kept for ``CACHED_WORDS`` words at most by those who call ``bounded`` now and then."""

    def __missing__(self, w: bytes) -> int:
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def bounded(self) -> None:
        if len(self) > CACHED_WORDS:
            self.clear()


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def give_back() -> None:
    """Return freed memory to the system. Python workers outlive their task, and what they hold on to is missing elsewhere on the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over a partition's batches, with freed memory given back at the partition's end."""

    @functools.wraps(f)
    def g(it: Iterator) -> Iterator:
        try:
            yield from f(it)
        finally:
            give_back()

    return g


def lean_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f over a group, with freed memory given back after large groups."""

    @functools.wraps(f)
    def g(t: pa.Table) -> pa.Table:
        out = f(t)
        if t.nbytes > 4_000_000:
            del t
            give_back()
        return out

    return g


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that the session names in spark.checkpoint.dir."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local one if Spark runs on this machine alone, else an error."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="palaver-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: rows that every later read meets in the same files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._written_at = path
    return out


def steady(df: DataFrame) -> DataFrame:
    """df, if it comes straight from files, whose rows every read meets in the same order; else its rows as a written table.

    For operators that read their input twice: after a shuffle, a task that runs again may meet its rows in another order.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    straight = all(w not in plan for w in ("Exchange", "Join", "Python", "Arrow", "Pandas", "rand("))
    return df if straight else written(df, "steady")


def discard(df: DataFrame) -> None:
    """Remove the files of a ``written`` table that nothing lazy reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def if_small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows (of a few numbers each); else Spark shuffles for its join. The result is the same."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component_id) of every node on an edge; component_id is the least node that links reach.

    Rounds of large-star and small-star keep the number of edges at that of the input, also around
    a node with very many neighbours, and end after a number of rounds logarithmic in the longest path.
    Nulls and self-loops are dropped; repeated edges count once.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
        .where(F.col("hi") != F.col("lo"))
        .distinct()
    )
    e, before = checkpoint(e), None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(e.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        # large star: every larger neighbour of n moves to the least of n's neighbourhood
        large = both.join(least, "n").where(F.col("m") > F.col("n")).select(F.col("m").alias("hi"), F.col("least").alias("lo")).distinct()
        # small star: n and its smaller neighbours move to the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = (
            large.join(low, "hi")
            .select(F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("least").alias("lo"))
            .where(F.col("hi") != F.col("lo"))
            .distinct()
        )
        e = checkpoint(small)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = e.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("component_id"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component_id")).unionByName(roots)
