"""Answers kept by question and by the stamp of the data they were made from.

A question is a row of parameters; its key is a hash of stamp and parameters, in whatever order they come. Asked again while the stamp is the same, it is
answered from the table, and nothing else is read; under a new stamp old answers are as good as none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import cache_key
from palaver.sources.store import Store

SCHEMA = "key string, stamp string, answer string"


def with_key(stamp: str, asked: DataFrame) -> DataFrame:
    """asked with key, the hash of stamp and all parameters that aren't null."""
    cols = sorted(asked.columns)
    given = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*[F.col(c).cast("string") for c in cols])), lambda _, v: v.isNotNull())
    return asked.withColumn("key", cache_key(F.lit(stamp), given))


def answered(store: Store, stamp: str, asked: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """asked (each question once) with key and answer, a JSON string.

    ``compute`` gets the questions without an answer, with their key, and gives (key, answer); it isn't called if there are none. What it
    leaves out stays without an answer (null) and is asked again next time. Answers under other stamps go with the next commit. The store's key column is "key".
    """
    questions, known = with_key(stamp, asked.distinct()), store.read("answers")
    known = asked.sparkSession.createDataFrame([], SCHEMA) if known is None else known.where(F.col("stamp") == stamp)
    todo = questions.join(known.select("key"), "key", "left_anti")
    if not todo.isEmpty():
        new = compute(todo).where("answer is not null").select("key", F.lit(stamp).alias("stamp"), "answer")
        store.commit({"answers": known.unionByName(new)})
        known = store.read("answers").where(F.col("stamp") == stamp)
    return questions.join(known.select("key", "answer"), "key", "left")
