"""Who talks: guests, line-ups, hours, shares. All but hours read ``lines.talk`` rows with the episode's series, date and kind joined on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import is_person, word_pattern
from palaver.operators.flow import longest_runs
from palaver.operators.lines import durations, lengths
from palaver.operators.pages import known_as
from palaver.session import kept


def guests(talk: DataFrame, hosts: Sequence[str], least: int = 60) -> DataFrame:
    """(name, count, all_series, first, last, talk) of those who are no hosts and talk ``least`` seconds in an episode."""
    g = talk.where(~F.col("spk").isin(list(hosts)) & (F.col("sec") >= least))
    return g.groupBy(F.col("spk").alias("name")).agg(
        F.count(F.lit(1)).alias("count"), F.array_join(F.sort_array(F.collect_set("series")), ",").alias("all_series"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("sec").alias("talk"),
    )


def lineup(talk: DataFrame, hosts: Sequence[str], least: int = 120) -> DataFrame:
    """(ep, hosts, guests): who talks at least ``least`` seconds, hosts in their own order, guests by name."""
    there = talk.where(F.col("sec") >= least).groupBy("ep").agg(F.collect_set("spk").alias("all"))
    own = F.filter(F.array(*map(F.lit, hosts)), lambda h: F.array_contains("all", h))
    return there.select("ep", own.alias("hosts"), F.sort_array(F.array_except("all", F.array(*map(F.lit, hosts)))).alias("guests"))


def substitutes(lineups: DataFrame, hosts: Sequence[str]) -> DataFrame:
    """(guest, host, n): how often a guest is there while a host isn't."""
    away = F.array_except(F.array(*map(F.lit, hosts)), "hosts")
    g = lineups.select(F.explode("guests").alias("guest"), away.alias("away"))
    return g.select("guest", F.explode("away").alias("host")).groupBy("guest", "host").agg(F.count(F.lit(1)).alias("n"))


def hours(lines: DataFrame, hosts: Sequence[str]) -> DataFrame:
    """(series, year, spk, hours): each host's over all lines, however short an appearance, and with spk null the audio's over all episodes.

    lines carry series and date.
    """
    d = durations(lines).withColumn("year", F.substring("date", 1, 4))
    own = d.where(F.col("spk").isin(list(hosts))).groupBy("series", "year", "spk").agg(F.round(F.sum("dur") / 3600, 6).alias("hours"))
    audio = lengths(d, "series", "year").groupBy("series", "year").agg(F.round(F.sum("len") / 3600, 6).alias("hours"))
    return own.unionByName(audio.withColumn("spk", F.lit(None).cast("string")))


def shares(talk: DataFrame) -> DataFrame:
    """(spk, year, share, wpm, turn_sec): share is the mean of the episodes' shares, pace and turn length are ratios of sums."""
    return talk.groupBy("spk", "year").agg(
        F.round(F.avg(F.when(F.col("len") > 0, F.col("sec") / F.col("len"))), 6).alias("share"),
        F.round(F.sum("words") * 60.0 / F.sum("sec"), 6).alias("wpm"),
        F.round(F.sum("sec") / F.nullif(F.sum("turns"), F.lit(0)), 6).alias("turn_sec"),
    )


def summary(talk: DataFrame, episodes: DataFrame, hosts: Sequence[str]) -> DataFrame:
    """One row of headline figures: hours, the hosts' mean share, the longest talker, the most frequent guest.

    episodes is (ep, len) of all episodes, also of those without a row in talk.
    """
    own = talk.where(F.col("spk").isin(list(hosts))).groupBy("ep").agg(F.sum("sec").alias("own"))
    per = episodes.select("ep", F.round(F.round("len", 6)).cast("long").alias("len")).join(own, "ep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    a = per.agg(F.count(F.lit(1)).alias("episodes"), F.round(F.sum("len") / 3600, 6).alias("hours"), F.round(F.avg(F.when(F.col("len") > 0, F.col("own") / F.col("len"))), 6).alias("host_share"), F.median("len").alias("median_len"))
    top = talk.groupBy("spk").agg(F.sum("sec").alias("s"), F.count(F.lit(1)).alias("n")).agg(F.max_by("spk", F.struct("s", "spk")).alias("most_talk"), F.max_by("spk", F.struct("n", "spk")).alias("most_episodes"))
    return a.join(F.broadcast(top))  # one row each


def spoken(lines: DataFrame, strict: Sequence[str], swears: Sequence[str], phrases: Sequence[str], items: Sequence[str]) -> DataFrame:
    """(ep, series, date, kind, spk, sec, len, swears, items, phrases, hit) per episode and speaker, in one pass over lines.

    swears and items are counts, phrases an array of counts in the order given, hit the first line with a ``strict`` word (t, id). sec isn't rounded, len is the episode's.
    """
    # Patterns are counted before the windows, so that these deal out and sort numbers instead of texts.
    n = lambda ws: F.regexp_count("text", F.lit(word_pattern(ws))).cast("long") if ws else F.lit(0).cast("long")
    said = {"_swears": n(swears), "_items": n(items), "_strict": F.col("text").rlike(word_pattern(strict))} | {f"_phrase{i}": n([p]) for i, p in enumerate(phrases)}
    d = durations(lines.select("ep", "id", "t", "spk", "series", "date", "kind", "words", "chars", *[c.alias(k) for k, c in said.items()]))
    d = d.withColumn("_len", F.max(F.struct("t", "id", "dur")).over(Window.partitionBy("ep")))
    first = F.min(F.when(F.col("_strict"), F.struct("t", "id")))
    return d.groupBy("ep", "series", "date", "kind", "spk").agg(
        F.sum("dur").alias("sec"), F.round(F.round(F.first(F.col("_len.t") + F.col("_len.dur")), 6)).cast("long").alias("len"), F.sum("_swears").alias("swears"), F.sum("_items").alias("items"),
        F.array(*[F.sum(f"_phrase{i}") for i in range(len(phrases))]).alias("phrases"), first.alias("hit"),
    )


def _ranked(rows: DataFrame, order: Sequence, of: Sequence[str], k: int, name: str) -> DataFrame:
    """One row: the first ``k`` of rows as an array of structs."""
    first = rows.orderBy(*order).limit(k).withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # k rows
    return first.agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", *of))), lambda x: F.struct(*[x[c].alias(c) for c in of])).alias(name))


def headlines(lines: DataFrame, hosts: Sequence[str], show: str, strict: Sequence[str], swears: Sequence[str], phrases: Sequence[str], items: Sequence[str], facts: DataFrame, people: DataFrame, vocabulary: DataFrame, main: Sequence[str] = ("Main",), hours: float = 20, run: dict | None = None) -> DataFrame:
    """One row of fifteen figures, nested, for the main episodes of ``show`` or, where nothing else is said, all episodes.

    ttp: episodes with a strict word, of how many, median second, and the fastest; talk: hosts by mean share of what hosts say, in percent; guests: the three in most episodes;
    swears: the three with most an hour, of those with more than ``hours``; phrases: the three most frequent; facts (who): total and top four; lineup: episodes with all
    hosts; episodes; hours; hours_by_year; hosts; flow: the hosts' longest run; style: the richest vocabulary (``vocabulary``: person, ttr); mentions: items an hour and
    show; pod: friends and enemies (``people``: friend, enemy). Lines are read twice: once for all counts by episode and speaker, once for runs. Ties go by name.
    """
    p = kept(spoken(lines, strict, swears, phrases, items))
    own, ours = F.col("spk").isin(list(hosts)), F.col("series") == show
    said = p.where(is_person(F.col("spk")) & (F.round("sec", 6) >= 30)).withColumn("sec", F.round(F.round("sec", 6)).cast("long"))
    chief = F.col("kind").isin(list(main))
    episodes = p.groupBy("ep", "series", "date", "kind").agg(F.first("len").alias("len"), F.min(F.when(F.col("hit").isNotNull(), F.struct("hit.t", "hit.id", F.col("spk").alias("who")))).alias("hit"), F.sum("items").alias("items"))
    ttp = episodes.where(chief & ours).agg(
        F.count("hit").alias("with"), F.count(F.lit(1)).alias("of"), F.median("hit.t").alias("median"), F.min(F.when(F.col("hit").isNotNull(), F.struct("hit.t", "date", "ep", "hit.who"))).alias("fastest"),
    )
    present = said.where(ours & chief)
    share = F.col("sec") / F.greatest(F.sum("sec").over(Window.partitionBy("ep")), F.lit(1))
    talk = present.where(own).withColumn("share", share).groupBy("spk").agg(F.round(100 * F.avg("share"), 1).alias("percent"))
    guests_ = said.where(~own & (F.col("sec") >= 60)).groupBy("spk").agg(F.count(F.lit(1)).alias("n"), F.sum("sec").alias("s"))
    swear = p.groupBy("spk").agg(F.sum("swears").alias("n")).join(said.groupBy("spk").agg(F.sum("sec").alias("s")), "spk").where((F.col("n") > 0) & (F.col("s") > hours * 3600))
    swear = swear.select("spk", F.round(3600 * F.col("n") / F.col("s"), 1).alias("rate"))
    phrase = p.select(F.posexplode("phrases").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("n")).where("n > 0")
    phrase = phrase.select(F.element_at(F.array(*map(F.lit, phrases)), F.col("k") + 1).alias("phrase"), "n")
    total = facts.agg(F.count(F.lit(1)).alias("total"))
    fact = facts.where("coalesce(who, '') != ''").groupBy("who").agg(F.count(F.lit(1)).alias("n"))
    there = said.where(ours & chief).groupBy("ep").agg(F.count(F.when(own & (F.col("sec") >= 120), 1)).alias("n")).agg(F.count(F.when(F.col("n") == len({*hosts}), 1)).alias("all"), F.count(F.lit(1)).alias("of"))
    year = F.substring("date", 1, 4)
    by_year = episodes.groupBy("series", year.alias("year")).agg(F.round(F.sum("len") / 3600, 2).alias("hours"))
    per_show = episodes.groupBy("series").agg(F.round(F.sum("items") / F.nullif(F.sum("len") / 3600, F.lit(0.0)), 1).alias("rate"))
    runs = longest_runs(lines.where(ours & chief), **(run or {})).where(own)
    rows = [
        ttp.select(F.struct("*").alias("ttp")),
        _ranked(talk, [F.desc("percent"), "spk"], ["spk", "percent"], len(hosts), "talk"),
        _ranked(guests_, [F.desc("n"), F.desc("s"), "spk"], ["spk", "n"], 3, "guests"),
        _ranked(swear, [F.desc("rate"), "spk"], ["spk", "rate"], 3, "swears"),
        _ranked(phrase, [F.desc("n"), "phrase"], ["phrase", "n"], 3, "phrases"),
        _ranked(fact, [F.desc("n"), "who"], ["who", "n"], 4, "top").join(F.broadcast(total)).select(F.struct("total", "top").alias("facts")),
        there.select(F.struct("*").alias("lineup")),
        episodes.agg(F.count(F.lit(1)).alias("episodes"), F.round(F.sum("len") / 3600).cast("long").alias("hours")),
        by_year.agg(F.array_sort(F.collect_list(F.struct("series", "year", "hours"))).alias("hours_by_year")),  # a row a show and year
        lines.sparkSession.createDataFrame([(list(hosts),)], "hosts array<string>"),
        runs.agg(F.max_by(F.struct("spk", "sec"), F.struct("sec", "spk")).alias("flow")),
        vocabulary.agg(F.max_by(F.struct("person", "ttr"), F.struct("ttr", "person")).alias("style")),
        per_show.agg(F.array_sort(F.collect_list(F.struct("series", "rate"))).alias("mentions")),
        people.agg(F.struct(F.count(F.when(F.col("friend"), 1)).alias("friends"), F.count(F.when(F.col("enemy"), 1)).alias("enemies")).alias("pod")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.join(F.broadcast(r))  # one row each
    return out


def guest_episodes(talk: DataFrame, hosts: Mapping[str, Sequence[str]], aliases: Mapping[str, str], never: Sequence[str] = (), least: int = 60) -> DataFrame:
    """(name, count, shows, first, last, talk, eps): who is no host of the show (``hosts`` by series) and talks ``least`` seconds, under their main name.

    eps is an array of (date, ep, series, sec) by date: as long as a guest has episodes.
    """
    host = F.lit(False)
    for series, names in hosts.items():
        host = host | ((F.col("series") == series) & F.col("spk").isin(list(names)))
    t = talk.where(~host & ~F.col("spk").isin(list(never)) & (F.col("sec") >= least)).withColumn("name", known_as(F.col("spk"), aliases))
    eps = F.array_sort(F.collect_list(F.struct("date", "ep", "series", "sec")))
    return t.groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_set("series")).alias("shows"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("sec").alias("talk"), eps.alias("eps"))
