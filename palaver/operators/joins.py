"""Joins near in time, and what is left of a table after another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], within: int = 30) -> DataFrame:
    """left (with t) and the nearest row of right (r_id, r_t) with equal keys within ``within`` seconds; ties to the least r_id.

    Rows meet in buckets of ``within`` seconds, a left row in its own and both next to it, so a long recording is no one group.
    """
    w = int(within)
    l = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_b", F.explode(F.array(*[F.floor(F.col("t") / w) + k for k in (-1, 0, 1)])))
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], "r_id", "r_t", F.floor(F.col("r_t") / w).alias("_rb"))
    on = (F.col("_b") == F.col("_rb")) & (F.abs(F.col("t") - F.col("r_t")) <= within)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    best = F.min(F.struct(F.abs(F.col("t") - F.col("r_t")).alias("d"), "r_id", "r_t"))
    return l.join(r, on).groupBy("_row", *left.columns).agg(best.alias("_m")).select(*left.columns, "_m.r_id", "_m.r_t")


def first_ahead(left: DataFrame, right: DataFrame, keys: Sequence[str], within: int = 60) -> DataFrame:
    """left (with t) and the first row of right (r_id, r_t) at or after t, at most ``within`` seconds ahead."""
    w = int(within)
    l = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_b", F.explode(F.array(F.floor(F.col("t") / w), F.floor(F.col("t") / w) + 1)))
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], "r_id", "r_t", F.floor(F.col("r_t") / w).alias("_rb"))
    on = (F.col("_b") == F.col("_rb")) & F.col("r_t").between(F.col("t"), F.col("t") + within)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return l.join(r, on).groupBy("_row", *left.columns).agg(F.min(F.struct("r_t", "r_id")).alias("_m")).select(*left.columns, "_m.r_id", "_m.r_t")


def pending(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't done yet: vanished inputs, open work, curated keys without an episode."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with new's rows in place of those with equal keys."""
    return pending(old, new, keys).unionByName(new, allowMissingColumns=True)


def first_of(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The rows of the first frame that has them, by keys: hand-made entries before automatic ones."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(pending(f, out, keys))
    return out


def carry_forward(rows: DataFrame, by: str, order: Sequence[str], column: str) -> DataFrame:
    """rows with the last value of column that wasn't null or empty."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.coalesce(F.last(F.nullif(F.col(column), F.lit("")), True).over(w), F.lit("")))


def context(lines: DataFrame, at: DataFrame, reach: int = 2) -> DataFrame:
    """(ep, id, near): the texts of ``reach`` lines before and after each line of at (ep, id)."""
    w = Window.partitionBy("ep").orderBy("t", "id").rowsBetween(-reach, reach)
    return lines.withColumn("near", F.collect_list("text").over(w)).join(at.select("ep", "id"), ["ep", "id"], "left_semi").select("ep", "id", "near")


def sessions(rows: DataFrame, by: Sequence[str], gap: float) -> DataFrame:
    """(*by, start, end, n): runs of rows (start, end) whose gap stays under ``gap``."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = rows.withColumn("_new", F.when(F.coalesce(F.col("start") - reach < gap, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return s.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_run")


def check_windows(lines: DataFrame, size: int = 600, least_words: int = 300, least_ends: float = 3.0) -> DataFrame:
    """(ep, win, words, ends, ok): stretches of ``size`` seconds from the first line; wordy ones need sentence ends."""
    from palaver.functions.text import count_words

    d = lines.withColumn("_t0", F.min("t").over(Window.partitionBy("ep")))
    g = d.groupBy("ep", F.floor((F.col("t") - F.col("_t0")) / size).alias("win")).agg(F.sum(count_words(F.col("text"))).alias("words"), F.sum(F.regexp_count("text", F.lit("[.?!]"))).alias("ends"))
    return g.withColumn("ok", (F.col("words") < least_words) | (F.col("ends") * 100.0 / F.col("words") >= least_ends))
