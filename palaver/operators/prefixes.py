"""Names that begin with another one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owners(names: DataFrame, cut: str = " - ") -> DataFrame:
    """(name, owner) of each distinct name: the longest other name that its words begin with, else itself, in both cases without what follows ``cut``.

    Every name meets the names that equal one of its own beginnings (as many as it has words), never all names.
    """
    n = names.select("name").where("name is not null").distinct()
    d = n.withColumn("base", F.trim(F.substring_index("name", cut, 1)))
    words = F.split("base", " ")
    begins = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    b = d.select("name", "base", F.explode(F.array_distinct(begins)).alias("begin")).where("begin != base")
    hit = b.join(n.select(F.col("name").alias("begin")), "begin").groupBy("name").agg(F.max_by("begin", F.length("begin")).alias("owner"))
    return d.join(hit, "name", "left").select("name", F.coalesce("owner", "base").alias("owner"))


def by_owner(chunks: DataFrame, cut: str = " - ") -> DataFrame:
    """Profile chunks (name, emb) under their owners' names: recordings of one person in several files are one profile."""
    return chunks.join(owners(chunks, cut), "name").select(F.col("owner").alias("name"), "emb")
