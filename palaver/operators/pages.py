"""What pages of figures show: rates, favourites, rankings with a remainder, filters with their counts, sorted and paged lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_as(name: Column, aliases: Mapping[str, str]) -> Column:
    """The name that an alias stands for, else the name itself."""
    if not aliases:
        return name
    return F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[name], name)


def among(who: Column, people: Sequence[str], hosts: Sequence[str], others: str = "Guests") -> Column:
    """Whether a row is by one of the people chosen; ``others`` stands for whoever has a name and is no host. No choice takes all."""
    if not people:
        return F.lit(True)
    ok = who.isin([p for p in people if p != others])
    return ok | ((who != "") & ~who.isin(list(hosts))) if others in people else ok


def episode_group(kind: Column, main: Sequence[str] = ("Main", "Guest episode", "Issue")) -> Column:
    """ "m" for a main episode, "o" for any other."""
    return F.when(kind.isin(list(main)), "m").otherwise("o")


def guest_page(talk: DataFrame, hosts: Sequence[str], aliases: Mapping[str, str], where: Column | None = None, least: int = 60, top: int = 15) -> DataFrame:
    """(name, count, talk, first, last, again, rank): guests under their main name over the episodes chosen, by appearances, then talk, then name."""
    t = talk if where is None else talk.where(where)
    t = t.withColumn("name", known_as(F.col("spk"), aliases)).where(~F.col("name").isin(list(hosts)) & (F.col("sec") >= least))
    g = t.groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.sum("sec").alias("talk"), F.min("date").alias("first"), F.max("date").alias("last"))
    g = g.withColumn("again", F.col("count") > 1).orderBy(F.desc("count"), F.desc("talk"), "name").limit(top)
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), F.desc("talk"), "name")))  # ``top`` rows


def rates(said: DataFrame, seconds: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, n, sec, rate): how often in an hour, of who talks at all; who says nothing has rate 0."""
    n = said.groupBy(*by).agg(F.sum("n").alias("n"))
    s = seconds.groupBy(*by).agg(F.sum("sec").alias("sec")).where("sec > 0")
    return s.join(n, list(by), "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), "sec", F.round(3600 * F.coalesce("n", F.lit(0)) / F.col("sec"), 6).alias("rate"))


def favourites(said: DataFrame, item: str = "phrase", k: int = 10) -> DataFrame:
    """(item, n): the ``k`` that are said most; ties by item."""
    return said.groupBy(item).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), item).limit(k)


def top_of_each(said: DataFrame, by: str = "ep", item: str = "phrase") -> DataFrame:
    """(by, n, top): all that is said in an episode, and its most frequent item; ties to the least."""
    g = said.groupBy(by, item).agg(F.sum("n").alias("n"))
    return g.groupBy(by).agg(F.sum("n").alias("_all"), F.min_by(item, F.struct((-F.col("n")).alias("n"), item)).alias("top")).withColumnRenamed("_all", "n")


def cumulative_hits(levels: DataFrame, order: Sequence[str]) -> DataFrame:
    """(ep, mode, n, t, who): each level together with those before it: how often, and the earliest first hit (the first level's on a tie)."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("level"))
    wider = levels.withColumn("_rank", rank).where("_rank > 0").withColumn("mode", F.explode(F.slice(F.array(*map(F.lit, order)), F.col("_rank").cast("int"), F.lit(len(order)))))
    g = wider.groupBy("ep", "mode").agg(F.sum("n").alias("n"), F.min_by(F.struct("t", "who"), F.struct("t", "_rank")).alias("h"))
    return g.select("ep", "mode", "n", "h.t", "h.who")


def hit_summary(hits: DataFrame, hosts: Sequence[str]) -> DataFrame:
    """(mode, year, who, episodes, median, fastest, slowest) by grouping sets over mode: per year, and per first speaker (hosts, else Guest)."""
    who = F.when(F.col("who").isin(list(hosts)), F.col("who")).otherwise("Guest")
    rows = hits.withColumn("who", who)
    aggs = (F.count(F.lit(1)).alias("episodes"), F.round(F.median("t"), 6).alias("median"), F.min("t").alias("fastest"), F.max("t").alias("slowest"))
    year = rows.groupBy("mode", "year").agg(*aggs).withColumn("who", F.lit(None).cast("string"))
    return year.unionByName(rows.groupBy("mode", "who").agg(*aggs).withColumn("year", F.lit(None).cast("string")))


def ranked_with_rest(counts: DataFrame, item: str, who: str, top: int = 5, others: str = "others") -> DataFrame:
    """(item, rank, who, n, people): the ``top`` speakers of each item, and all further ones in one row."""
    c = counts.groupBy(item, who).agg(F.sum("n").alias("n"))
    c = c.withColumn("_rank", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("n"), who)))
    named = F.when(F.col("_rank") <= top, F.col(who)).otherwise(others)
    g = c.groupBy(item, F.least("_rank", F.lit(top + 1)).alias("rank"), named.alias("who")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("people"))
    return g.select(item, "rank", "who", "n", "people")


def filter_counts(facts: DataFrame, hosts: Sequence[str], section: str, least: int = 5, others: str = "Guests") -> DataFrame:
    """(filter, value, n): what each choice of person (hosts, else ``others``; the unnamed don't count) and of section would leave; rare sections go."""
    who = F.when(F.col("who").isin(list(hosts)), F.col("who")).otherwise(others)
    people = facts.where("who != ''").groupBy(who.alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("filter", F.lit("person"))
    parts = facts.where(F.coalesce(section, F.lit("")) != "").groupBy(F.col(section).alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).withColumn("filter", F.lit("section"))
    return people.unionByName(parts).select("filter", "value", "n")


def trademark(signatures: DataFrame, by: str = "person", among_first: int = 10) -> DataFrame:
    """(by, word, lift): the one word of all that its group's first ones say most over others; ties to the greatest group, then word."""
    return signatures.where(F.col("rank") <= among_first).agg(F.max_by(F.struct(by, "word", "lift"), F.struct("lift", by, "word")).alias("s")).select("s.*")


def sorted_rows(rows: DataFrame, column: str, descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Rows as a sortable table has them: empty cells last going up, and so first going down."""
    c = F.col(column)
    return rows.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), *ties)


def alphabetical(rows: DataFrame, column: str, ties: Sequence[str] = ()) -> DataFrame:
    """Rows from A to Z, whatever the case and accents."""
    return rows.orderBy(F.collate(F.col(column), "UNICODE_CI_AI"), *ties)


def page(rows: DataFrame, number: int, first: int = 100, more: int = 200) -> DataFrame:
    """The rows that the ``number``-th "show more" adds to an ordered table: ``first`` at 0, then ``more`` at a time."""
    return rows.limit(first) if number == 0 else rows.offset(first + (number - 1) * more).limit(more)


def one_at_random(rows: DataFrame, by: Sequence[str], key: str, seed: str) -> DataFrame:
    """A row of each group, drawn by a hash of its key: the same for the same seed, however the rows are dealt."""
    return rows.groupBy(*by).agg(F.min_by(key, F.struct(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)).alias(key))


def phrases_across_lines(lines: DataFrame, pattern: str, hint: str) -> DataFrame:
    """(ep, id, phrase, spans) of what fits pattern and begins in a line; spans if it ends in the next one. A phrase once a line.

    Only lines that fit ``hint``, a cheap pattern, together with the next are searched. Phrases stand in lower case, runs of blanks and
    hyphens as one blank.
    """
    after = F.coalesce(F.lead("text").over(Window.partitionBy("ep").orderBy("t", "id")), F.lit(""))
    d = lines.withColumn("_joined", F.concat("text", F.lit(" "), after)).where(F.col("_joined").rlike(hint))
    found = F.regexp_extract_all("_joined", F.lit(pattern), F.lit(0))
    # What stands between the matches tells where each begins.
    gaps = F.slice(F.split("_joined", pattern, -1), F.lit(1), F.size(found))
    begins = lambda a, x: a["at"] + F.length(x["gap"])
    told = lambda a, x: F.array(F.struct(F.trim(F.regexp_replace(F.lower(x["hit"]), r"[\s-]+", " ")).alias("phrase"), (begins(a, x) + F.length(x["hit"]) > F.length("text")).alias("spans")))
    walk = F.aggregate(
        F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("hit"), g.alias("gap"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<phrase:string,spans:boolean>>").alias("out")),
        lambda a, x: F.struct((begins(a, x) + F.length(x["hit"])).alias("at"), F.when(begins(a, x) < F.length("text"), F.concat(a["out"], told(a, x))).otherwise(a["out"]).alias("out")),
    )
    first = d.select("ep", "id", F.posexplode(walk["out"]).alias("_k", "_m"))
    return first.groupBy("ep", "id", F.col("_m.phrase").alias("phrase")).agg(F.min_by("_m.spans", "_k").alias("spans"))
