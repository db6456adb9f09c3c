"""How long lines and turns take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import is_person

#: A line's time is cut here; the slowest speech, in words a second; what the last line of an episode gets.
GAP_CAP, SLOW, LAST = 20, 1.5, 5


def durations(lines: DataFrame, cap: int = GAP_CAP, slow: float = SLOW, last: int = LAST) -> DataFrame:
    """lines with dur: the time to the next start, at most ``cap`` and the words at ``slow`` pace, at least a second a line; lines of one start share
    it by their characters."""
    back = Window.partitionBy("ep").orderBy(F.desc("t"))
    same = Window.partitionBy("ep", "t")
    step = F.when(F.lag("t").over(back) != F.col("t"), F.lag("t").over(back))
    d = lines.withColumn("_step", step)
    d = d.withColumn("_next", F.coalesce(F.last("_step", True).over(back.rowsBetween(Window.unboundedPreceding, 0)), F.col("t") + last))
    d = d.withColumns({"_n": F.count(F.lit(1)).over(same), "_words": F.sum("words").over(same), "_chars": F.sum(F.greatest(F.lit(1), "chars")).over(same)})
    total = F.greatest(F.col("_n").cast("double"), F.least(F.lit(float(cap)), (F.col("_next") - F.col("t")).cast("double"), F.col("_words") / slow))
    return d.withColumn("dur", total * F.greatest(F.lit(1), "chars") / F.col("_chars")).drop("_step", "_next", "_n", "_words", "_chars")


def lengths(timed: DataFrame, *keep: str) -> DataFrame:
    """(ep, *keep, len) of every episode of ``durations`` rows: the last start and its duration."""
    return timed.groupBy("ep", *keep).agg(F.max_by(F.col("t") + F.col("dur"), F.struct("t", "id")).alias("len"))


def line_seconds(lines: DataFrame, cap: int = GAP_CAP, slow: float = SLOW, last: int = LAST) -> DataFrame:
    """lines with sec: at least 1, at most the time to the next line and the longer of ``cap`` and the words at ``slow`` pace."""
    ahead = F.coalesce(F.lead("t").over(Window.partitionBy("ep").orderBy("t", "id")), F.col("t") + last)
    return lines.withColumn("sec", F.greatest(F.lit(1.0), F.least((ahead - F.col("t")).cast("double"), F.greatest(F.lit(float(cap)), F.col("words") / slow))))


def turns(lines: DataFrame) -> DataFrame:
    """lines with turn: the number of the run of lines by one speaker, within the episode from 1; unnamed lines make runs too."""
    w = Window.partitionBy("ep").orderBy("t", "id")
    new = F.when(F.lag("spk").over(w).eqNullSafe(F.col("spk")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return lines.withColumn("_new", new).withColumn("turn", F.sum("_new").over(w)).drop("_new")


def talk(lines: DataFrame, floor: float = 30.0) -> DataFrame:
    """(ep, spk, sec, words, turns, len): persons with at least ``floor`` seconds; len is the episode's last start and its duration."""
    d = durations(lines)
    w = Window.partitionBy("ep").orderBy("t", "id")
    starts = (is_person(F.col("spk")) & ~F.lag("spk").over(w).eqNullSafe(F.col("spk"))).cast("int")
    d = d.withColumns({"_start": starts, "_len": F.max(F.struct("t", "id", "dur")).over(Window.partitionBy("ep"))})
    out = d.where(is_person(F.col("spk"))).groupBy("ep", "spk").agg(F.sum("dur").alias("raw"), F.sum("words").alias("words"), F.sum("_start").alias("turns"), F.first(F.col("_len.t") + F.col("_len.dur")).alias("len"))
    return out.where(F.round("raw", 6) >= floor).select("ep", "spk", F.round(F.round("raw", 6)).cast("long").alias("sec"), F.col("words").cast("long").alias("words"), F.col("turns").cast("long").alias("turns"), F.round(F.round("len", 6)).cast("long").alias("len"))
