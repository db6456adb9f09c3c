"""Who hands over to whom, and the longest runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import is_person
from palaver.operators.lines import line_seconds, turns


def handovers(lines: DataFrame, hosts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, from, to, n): adjacent turns of two named speakers; those who are no hosts count as "Guest". An unnamed turn breaks the chain."""
    w = Window.partitionBy("ep").orderBy("turn")
    t = turns(lines).groupBy("ep", *by, "turn").agg(F.first("spk").alias("spk"))
    t = t.withColumn("next", F.lead("spk").over(w)).where(is_person(F.col("spk")) & is_person(F.col("next")))
    pooled = lambda c: F.when(F.col(c).isin(list(hosts)), F.col(c)).otherwise("Guest")
    return t.groupBy(*by, pooled("spk").alias("from"), pooled("next").alias("to")).agg(F.count(F.lit(1)).alias("n"))


def handover_shares(grid: DataFrame, by: Sequence[str] = (), least: float = 0.01) -> DataFrame:
    """grid with the share of a speaker's hand-overs, for speakers with at least ``least`` of all."""
    one = Window.partitionBy(*by, "from")
    total = grid.groupBy(*by).agg(F.sum("n").alias("_all")) if by else grid.agg(F.sum("n").alias("_all"))
    g = grid.withColumn("_own", F.sum("n").over(one))
    g = g.join(F.broadcast(total), list(by)) if by else g.join(F.broadcast(total))  # a row a group
    return g.where(F.col("_own") >= least * F.col("_all")).select(*by, "from", "to", "n", F.round(F.col("n") / F.col("_own"), 6).alias("share"))


def longest_runs(lines: DataFrame, top: int = 12, start: int = 180, end: int = 60, least: float = 30.0) -> DataFrame:
    """(ep, spk, begins, sec, lines): a person's longest runs, ``top`` each, inside [start, last - end], with someone else named before and after."""
    ep = Window.partitionBy("ep")
    t = turns(line_seconds(lines)).withColumn("_last", F.max("t").over(ep))
    r = t.groupBy("ep", "turn").agg(F.first("spk").alias("spk"), F.min("t").alias("begins"), F.sum("sec").alias("sec"), F.count(F.lit(1)).alias("lines"), F.max("_last").alias("_last"))
    person = is_person(F.col("spk"))
    w = Window.partitionBy("ep").orderBy("turn")
    name = F.when(person, F.col("spk"))
    # The two first and two last distinct speakers by turn tell whether somebody else stands before or after.
    r = r.withColumns({"_first": F.first(name, True).over(ep.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_end": F.last(name, True).over(ep.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    other_before = F.max(F.when(person & (F.col("spk") != F.col("_first")), 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("ep").orderBy(F.desc("turn"))
    other_after = F.max(F.when(person & (F.col("spk") != F.col("_end")), 1)).over(back.rowsBetween(Window.unboundedPreceding, -1))
    some_before = F.max(F.when(person, 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    some_after = F.max(F.when(person, 1)).over(back.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumns({"_b": F.when(F.col("spk") != F.col("_first"), some_before).otherwise(other_before), "_a": F.when(F.col("spk") != F.col("_end"), some_after).otherwise(other_after)})
    r = r.where(person & (F.round("sec", 6) >= least) & (F.col("begins") >= start) & (F.col("begins") + F.col("sec") <= F.col("_last") - end) & F.col("_b").isNotNull() & F.col("_a").isNotNull())
    line = Window.partitionBy("spk").orderBy(F.desc(F.round("sec", 6)), "ep", "begins")
    return r.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top).select("ep", "spk", F.col("begins").cast("long").alias("begins"), F.round("sec", 6).alias("sec"), "lines", "rank")


def pieces(lines: DataFrame, dash: str, least: float = 0.0) -> DataFrame:
    """(ep, turn, piece, spk, begins, sec, lines): persons' turns, cut at lines in which a dash marks a second voice; those lines are in no piece.

    lines come with sec; only pieces of ``least`` seconds stay.
    """
    second = F.col("text").rlike(dash)
    t = turns(lines).withColumn("piece", F.sum(second.cast("int")).over(Window.partitionBy("ep", "turn").orderBy("t", "id")))
    g = t.where(~second & is_person(F.col("spk"))).groupBy("ep", "turn", "piece").agg(F.first("spk").alias("spk"), F.min("t").alias("begins"), F.round(F.sum("sec"), 6).alias("sec"), F.count(F.lit(1)).alias("lines"))
    return g.where(F.col("sec") >= least)


def leaderboard(lines: DataFrame, hosts: Sequence[str], dash: str, start: int = 180, end: int = 60, least: float = 30.0, top: int = 12, guests: int = 60, main: Sequence[str] = ("Main", "Guest episode", "Issue"), reading: str = "(?!)", said: int = 14) -> DataFrame:
    """(series, grp, ep, spk, at, sec, said): persons' longest runs per show, ``top`` each in main ("m") and other ("o") episodes; of those of guests the ``guests`` longest.

    lines carry series, kind, title, words and text. A line with a dash that marks a second voice ends a run and is in none. A run begins between ``start`` and ``end`` seconds
    before the last line, takes ``least`` seconds, and counts only where someone else has spoken before its turn and still will after it. Titles that fit ``reading``
    are left out. Lengths are rounded half to even; ties go by ep and start. said are a run's first ``said`` words.
    """
    ep, line = Window.partitionBy("ep"), Window.partitionBy("ep").orderBy("t", "id")
    d = turns(line_seconds(lines)).withColumns({"k": F.row_number().over(line), "last": F.max("t").over(ep), "person": is_person(F.col("spk")), "dash": F.col("text").rlike(dash)})
    at = F.when(F.col("person"), F.struct("k", "spk"))
    d = d.withColumns({"a": F.min(at).over(ep), "z": F.max(at).over(ep)})
    d = d.withColumns({"a2": F.min(F.when(F.col("spk") != F.col("a.spk"), at)).over(ep)["k"], "z2": F.max(F.when(F.col("spk") != F.col("z.spk"), at)).over(ep)["k"]})
    turn = Window.partitionBy("ep", "turn")
    d = d.withColumns({"i": F.min("k").over(turn), "j": F.max("k").over(turn), "piece": F.sum(F.col("dash").cast("int")).over(turn.orderBy("t", "id"))})
    before = F.when(F.col("a.spk") != F.col("spk"), F.col("a.k")).otherwise(F.col("a2")) < F.col("i")
    after = F.when(F.col("z.spk") != F.col("spk"), F.col("z.k")).otherwise(F.col("z2")) > F.col("j")
    d = d.where(F.col("person") & ~F.col("dash") & before & after & ~F.col("title").rlike(reading))
    first = F.array_sort(F.collect_list(F.struct("k", "text")))  # a piece is part of a turn
    r = d.groupBy("series", "kind", "ep", "spk", "turn", "piece").agg(F.min("t").alias("at"), F.sum("sec").alias("raw"), F.first("last").alias("last"), first.alias("first"))
    r = r.where((F.round("raw", 6) >= least) & (F.col("at") >= start) & (F.col("at") <= F.col("last") - end))
    words = F.filter(F.split(F.array_join(F.transform("first", lambda x: x["text"]), " "), r"(?U)\s+"), lambda w: w != "")
    r = r.select("series", F.when(F.col("kind").isin(list(main)), "m").otherwise("o").alias("grp"), "ep", "spk", "at", F.bround(F.round("raw", 6)).cast("long").alias("sec"), F.array_join(F.slice(words, 1, said), " ").alias("said"))
    own = Window.partitionBy("series", "spk", "grp").orderBy(F.desc("sec"), "ep", "at")
    r = r.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= top)
    host = F.col("spk").isin(list(hosts))
    rest = Window.partitionBy("series", host).orderBy(F.desc("sec"), "ep", "at", "spk")  # at most ``top`` rows a person and group
    return r.withColumn("_g", F.when(~host, F.row_number().over(rest)).otherwise(0)).where(F.col("_g") <= guests).drop("_k", "_g")
