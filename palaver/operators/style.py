"""Which words tell people and years apart, and how varied a vocabulary is. Texts are (ep, person, year, text)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import is_person, tokens
from palaver.operators.folds import counted
from palaver.session import kept

PRIOR = 1000.0


def token_counts(texts: DataFrame, cap: int = 3) -> DataFrame:
    """(ep, person, year, word, n, capped): a row per episode and word, counts also cut at ``cap``."""
    c = counted(texts.select("ep", "person", "year", F.array_join(tokens(F.col("text")), " ").alias("words")), ["ep", "person", "year"])
    return c.withColumn("capped", F.least("n", F.lit(cap)))


def frequencies(counts: DataFrame, by: str) -> DataFrame:
    """(by, word, n, capped, eps): of episodes' counts."""
    return counts.groupBy(by, "word").agg(F.sum("n").alias("n"), F.sum("capped").alias("capped"), F.count(F.lit(1)).alias("eps"))


def log_odds(y_a: Column, n_a: Column, y_b: Column, n_b: Column, prior: Column, n: Column, strength: float = PRIOR) -> Column:
    """z of the log-odds ratio with an informative Dirichlet prior."""
    a = F.lit(strength) * prior / n
    delta = F.log((y_a + a) / (n_a + strength - y_a - a)) - F.log((y_b + a) / (n_b + strength - y_b - a))
    return delta / F.sqrt(1 / (y_a + a) + 1 / (y_b + a))


def signatures(counts: DataFrame, by: str = "person", value: str = "n", least: int = 30, episodes: int = 10, lift: float = 1.5, length: int = 3, k: int = 20) -> DataFrame:
    """(by, word, z, n, lift, rank): the words that set a group apart from the rest, ``k`` each."""
    f = kept(counts.groupBy(by, "word").agg(F.sum(value).alias("y"), F.count(F.lit(1)).alias("eps")))  # what all totals come from
    word = f.groupBy("word").agg(F.sum("y").alias("w"))
    group = f.groupBy(by).agg(F.sum("y").alias("n_a"))
    total = group.agg(F.sum("n_a").alias("n_all"))
    j = f.where((F.col("y") >= least) & (F.col("eps") >= episodes) & (F.length("word") >= length)).join(word, "word").join(F.broadcast(group.join(F.broadcast(total))), by)  # a row a group
    y_b, n_b = F.col("w") - F.col("y"), F.col("n_all") - F.col("n_a")
    z = log_odds(F.col("y"), F.col("n_a"), y_b, n_b, F.col("w"), F.col("n_all"))
    up = (F.col("y") / F.col("n_a")) / (F.greatest(y_b.cast("double"), F.lit(0.5)) / n_b)
    s = j.select(by, "word", F.round(z, 6).alias("z"), F.col("y").alias("n"), F.round(up, 6).alias("lift")).where((F.col("z") > 0) & (F.col("lift") >= lift))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("z"), "word"))).where(F.col("rank") <= k)


def within(lines: DataFrame, start: int = 180, end: int = 180) -> DataFrame:
    """lines from ``start`` seconds on to ``end`` seconds before the episode's last one, both inclusive: without intro and outro."""
    return lines.withColumn("_last", F.max("t").over(Window.partitionBy("ep"))).where((F.col("t") >= start) & (F.col("t") <= F.col("_last") - end)).drop("_last")


def host_signatures(lines: DataFrame, hosts: Mapping[str, Sequence[str]], skip: Sequence[str] = (), names: str = "(?!)", least: int = 30, episodes: int = 10, lift: float = 1.5, length: int = 3, k: int = 40) -> DataFrame:
    """(series, spk, word, z, n, lift, rank): the words that set a host apart from everyone else named on the same show.

    lines are (series, ep, spk, text). The prior are the words of all lines of all shows, unnamed speakers' too. A word has to be said ``least`` times in ``episodes`` episodes and
    ``lift`` times as often as by the others (who count as half a time at least), to have ``length`` letters and be neither in ``skip`` nor fit ``names``.
    """
    said = lines.select("series", "ep", F.when(is_person(F.col("spk")), F.col("spk")).otherwise("").alias("spk"), F.array_join(tokens(F.col("text")), " ").alias("words"))
    per = counted(said, ["series", "ep", "spk"])
    f = kept(per.groupBy("series", "spk", "word").agg(F.sum("n").alias("y"), F.count(F.lit(1)).alias("eps")))  # what all totals come from
    prior = f.groupBy("word").agg(F.sum("y").alias("prior"))
    everything = f.agg(F.sum("y").alias("n_prior"))
    named = f.where("spk != ''")
    show = named.groupBy("series", "word").agg(F.sum("y").alias("show"))
    size = named.groupBy("series", "spk").agg(F.sum("y").alias("n_a")).withColumn("n_show", F.sum("n_a").over(Window.partitionBy("series")))  # a row a person and show
    host = F.lit(False)
    for series, who in hosts.items():
        host = host | ((F.col("series") == series) & F.col("spk").isin(list(who)))
    c = named.where(host & (F.col("y") >= least) & (F.col("eps") >= episodes) & (F.length("word") >= length) & ~F.col("word").isin(list(skip)) & ~F.col("word").rlike(f"^(?:{names})"))
    j = c.join(show, ["series", "word"]).join(size, ["series", "spk"]).join(prior, "word").join(F.broadcast(everything))
    y_b, n_b = F.col("show") - F.col("y"), F.col("n_show") - F.col("n_a")
    z = log_odds(F.col("y"), F.col("n_a"), y_b, n_b, F.col("prior"), F.col("n_prior"))
    up = (F.col("y") / F.col("n_a")) / (F.greatest(y_b.cast("double"), F.lit(0.5)) / n_b)
    s = j.select("series", "spk", "word", F.round(z, 6).alias("z"), F.col("y").alias("n"), F.round(up, 6).alias("lift")).where((F.col("z") > 0) & (F.col("lift") >= lift))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("series", "spk").orderBy(F.desc("z"), "word"))).where(F.col("rank") <= k)


def vocabulary(texts: DataFrame, by: str = "person", block: int = 1000, least: int = 10_000) -> DataFrame:
    """(by, ttr, words): mean distinct words in a full block of ``block``, in the order of episodes, for those with ``least`` words.

    Places come from running sums over episodes, so tokens are never sorted by group; windows see a number an episode.
    """
    t = texts.select(by, "ep", tokens(F.col("text")).alias("toks"))
    line = Window.partitionBy(by).orderBy("ep")
    sizes = t.select(by, "ep", F.size("toks").alias("size")).withColumns({"before": F.sum("size").over(line) - F.col("size"), "all": F.sum("size").over(Window.partitionBy(by))}).where(F.col("all") >= least)
    j = t.join(sizes, [by, "ep"]).where("size > 0")
    cut = F.sequence(F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("size") - 1) / block))
    begin = F.greatest(F.col("block") * block - F.col("before"), F.lit(0)).cast("int")
    end = F.least((F.col("block") + 1) * block - F.col("before"), F.col("size")).cast("int")
    b = j.withColumn("block", F.explode(cut)).where(F.col("block") < F.floor(F.col("all") / block))
    # An episode's part of a block travels as one array; a block holds ``block`` words.
    b = b.select(by, "block", "all", F.array_distinct(F.slice("toks", begin + 1, end - begin)).alias("part"))
    per = b.groupBy(by, "block").agg(F.size(F.array_distinct(F.flatten(F.collect_list("part")))).alias("d"), F.first("all").alias("all"))
    return per.groupBy(by).agg(F.round(F.avg("d") / block, 6).alias("ttr"), F.first("all").alias("words"))


def fragments(texts: DataFrame, least: int = 3, share: float = 1 / 3) -> DataFrame:
    """(word, uses, glued): tokens that in at least ``share`` of their uses make, with a neighbour, a word known ``least`` times."""
    line = [c for c in ("ep", "id") if c in texts.columns]
    seq = texts.select(*line, F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    w = Window.partitionBy(*line).orderBy("pos")
    s = seq.withColumns({"left": F.concat(F.lag("word").over(w), "word"), "right": F.concat("word", F.lead("word").over(w))})
    known = seq.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")
    j = s.join(known.withColumnRenamed("word", "_l"), F.col("left") == F.col("_l"), "left").join(known.withColumnRenamed("word", "_r"), F.col("right") == F.col("_r"), "left")
    u = j.groupBy("word").agg(F.count(F.lit(1)).alias("uses"), F.sum((F.col("_l").isNotNull() | F.col("_r").isNotNull()).cast("long")).alias("glued"))
    return u.where((F.col("glued") > 0) & (F.col("glued") >= share * F.col("uses")))


def fewer(a: DataFrame, b: DataFrame, key: str = "word", n: str = "n") -> DataFrame:
    """The multiset difference a - b: what is left above 0."""
    return a.join(b.select(key, F.col(n).alias("_b")), key, "left").withColumn(n, F.col(n) - F.coalesce("_b", F.lit(0))).where(F.col(n) > 0).drop("_b")


def combined(a: DataFrame, b: DataFrame, key: str = "word", n: str = "n") -> DataFrame:
    """The multiset sum a + b."""
    return a.select(key, n).unionByName(b.select(key, n)).groupBy(key).agg(F.sum(n).alias(n))


def trimmed(ranked: DataFrame, by: str, drop: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` of each group once the words of drop are out: ranked comes with more, so that the list stays full."""
    left = ranked.join(drop.select("word").distinct(), "word", "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rank"))).where(F.col("rank") <= k)


def year_words(counts: DataFrame, skip=(), furniture=(), show: str = "person", least: int = 30, episodes: int = 8, share: float = 0.05, lift: float = 2.0, year_least: int = 10, length: int = 3, k: int = 20) -> DataFrame:
    """(show, year, word, z, n, eps, rank): the words that set a year apart from the show's other years, by counts capped per episode.

    A word has to be said ``least`` times (uncapped), in ``episodes`` episodes and a ``share`` of the year's, ``lift`` times the share of
    episodes it gets in other years; what is said about once an episode in many episodes, or in three quarters of them, is furniture.
    Years with fewer than ``year_least`` episodes have no words. The list is as long as ``trimmed`` may need: twice ``k``.
    """
    sets = [[F.col(show), F.col("year"), F.col("word")], [F.col(show), F.col("year"), F.col("ep")]]  # words and episodes of one reading of counts
    g = counts.groupingSets(sets, show, "year", "word", "ep").agg(F.grouping("word").alias("_ep"), F.sum("n").alias("n"), F.sum("capped").alias("cap"), F.count(F.lit(1)).alias("eps"))
    g = kept(g)  # what all totals come from
    f = g.where("_ep = 0").drop("_ep", "ep")
    word = f.groupBy("word").agg(F.sum("cap").alias("prior"))
    whole = f.groupBy(show, "word").agg(F.sum("cap").alias("whole"), F.sum("eps").alias("whole_eps"))
    year = g.where("_ep = 1").groupBy(show, "year").agg(F.count("ep").alias("n_eps")).join(f.groupBy(show, "year").agg(F.sum("cap").alias("n_a")), [show, "year"])
    all_ = year.groupBy(show).agg(F.sum("n_eps").alias("all_eps"), F.sum("n_a").alias("n_all"))
    total = all_.agg(F.sum("n_all").alias("n_prior"))
    year = year.where(F.col("n_eps") >= year_least).join(all_, show).join(F.broadcast(total))  # a row a year and show
    c = f.where((F.col("n") >= least) & (F.length("word") >= length) & ~F.col("word").isin([*skip, *furniture]))
    j = c.join(year, [show, "year"]).join(whole, [show, "word"]).join(word, "word")
    need = F.greatest(F.lit(episodes), F.ceil(F.lit(share) * F.col("n_eps")))
    other = (F.col("whole_eps") - F.col("eps") + 1) / F.greatest(F.col("all_eps") - F.col("n_eps"), F.lit(1))
    j = j.where((F.col("eps") >= need) & (F.col("eps") / F.col("n_eps") >= lift * other) & (F.col("eps") < 0.75 * F.col("n_eps")))
    j = j.where(~((F.col("n") < 1.25 * F.col("eps")) & (F.col("eps") >= F.greatest(F.lit(10.0), F.col("n_eps") / 4))))
    z = log_odds(F.col("cap"), F.col("n_a"), F.col("whole") - F.col("cap"), F.col("n_all") - F.col("n_a"), F.col("prior"), F.col("n_prior"))
    s = j.select(show, "year", "word", F.round(z, 6).alias("z"), "n", "eps").where("z > 0")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(show, "year").orderBy(F.desc("z"), "word"))).where(F.col("rank") <= 2 * k)
