"""Word and phrase counts, first hits, and the word tracker. Lines are (ep, id, t, spk, text) with what the caller groups by."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import blank_out, is_person, phrase_key, word_pattern


def hits(lines: DataFrame, words: Sequence[str], keep: Sequence[str], exclusions: Sequence[str] = ()) -> DataFrame:
    """(*keep, phrase): a row per match, in one form."""
    text = blank_out(F.col("text"), exclusions) if exclusions else F.col("text")
    return lines.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(word_pattern(words)), F.lit(0))).alias("_hit")).withColumn("phrase", phrase_key(F.col("_hit"))).drop("_hit")


def phrase_counts(lines: DataFrame, words: Sequence[str], by: Sequence[str] = ("ep", "spk"), unnamed: str = "?") -> DataFrame:
    """(*by, phrase, n): unnamed speakers count as ``unnamed``."""
    named = lines.withColumn("spk", F.when(F.coalesce("spk", F.lit("")) == "", unnamed).otherwise(F.col("spk")))
    return hits(named, words, by).groupBy(*by, "phrase").agg(F.count(F.lit(1)).alias("n"))


def hit_levels(lines: DataFrame, levels: Mapping[str, Sequence[str]], exclusions: Sequence[str] = (), clip: int = 220) -> DataFrame:
    """(ep, level, n, t, word, who, line): how often each level's words occur in an episode, and the first line with one."""
    text = blank_out(F.col("text"), exclusions) if exclusions else F.col("text")
    d = lines.withColumn("_t", text)
    rows = [d.where(F.col("_t").rlike(p)).select("ep", F.lit(name).alias("level"), F.regexp_count("_t", F.lit(p)).alias("n"), F.struct("t", "id", phrase_key(F.regexp_extract("_t", f"({p})", 1)).alias("word"), F.col("spk").alias("who"), F.substring("text", 1, clip).alias("line")).alias("hit")) for name, words in levels.items() for p in [word_pattern(words)]]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    first = out.groupBy("ep", "level").agg(F.sum("n").alias("n"), F.min_by("hit", F.struct("hit.t", "hit.id")).alias("hit"))
    return first.select("ep", "level", "n", "hit.t", "hit.word", "hit.who", "hit.line")


def mentions(lines: DataFrame, items: Mapping[str, Sequence[str]], by: Sequence[str], hosts: Sequence[str], others: str = "Others") -> DataFrame:
    """(item, *by, who, n) by grouping sets: per item and ``by``, the same per speaker (hosts, else ``others``), with level saying which."""
    spellings = {s.lower(): item for item, ways in items.items() for s in ways}  # a later item wins
    rows = hits(lines, list(spellings), ["spk", *by])
    item = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])[F.col("phrase")]
    who = F.when(F.col("spk").isin(list(hosts)), F.col("spk")).otherwise(others)
    r = rows.select(item.alias("item"), *by, who.alias("who")).groupBy("item", *by, "who").agg(F.count(F.lit(1)).alias("n"))
    sets = [[F.col("item"), *[F.col(c) for c in by]], [F.col("item"), *[F.col(c) for c in by], F.col("who")]]
    return r.groupingSets(sets, "item", *by, "who").agg(F.grouping("who").alias("level"), F.sum("n").alias("n")).select("item", *by, "who", "level", "n")


def mention_cube(lines: DataFrame, items: Mapping[str, Sequence[str]], hosts: Mapping[str, Sequence[str]], exclusions: Sequence[str] = (), others: str = "Others", unknown: str = "Unknown") -> DataFrame:
    """(item, series, year, spk, who, n) in three groupings of one count: item, series and year; these and spk (persons, else ``unknown``); series, who (the show's hosts, else
    ``others``) and year. Columns outside a grouping are null."""
    spellings = {s.lower(): item for item, ways in items.items() for s in ways}  # a later item wins
    rows = hits(lines, list(spellings), ["series", "year", "spk"], exclusions)
    item = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])[F.col("phrase")]
    host = F.lit(False)
    for series, names in hosts.items():
        host = host | ((F.col("series") == series) & F.col("spk").isin(list(names)))
    who = F.when(host, F.col("spk")).otherwise(others)
    r = rows.select(item.alias("item"), "series", "year", F.when(is_person(F.col("spk")), F.col("spk")).otherwise(unknown).alias("spk"), who.alias("who")).groupBy("item", "series", "year", "spk", "who").agg(F.count(F.lit(1)).alias("n"))
    sets = [["item", "series", "year"], ["item", "series", "year", "spk"], ["series", "who", "year"]]
    g = r.groupingSets([[F.col(c) for c in s] for s in sets], "item", "series", "year", "spk", "who").agg(F.grouping_id("item", "series", "year", "spk", "who").alias("grouping"), F.sum("n").alias("n"))
    return g.select("item", "series", "year", "spk", "who", "grouping", "n")


def matched(lines: DataFrame, words: Sequence[str], where: Column | None = None) -> DataFrame:
    """lines with a match, said (how many, at least 1), len (the episode's last start), tenth (0 to 9) and slot (five minutes, 0 to 23)."""
    if len(words) > 8 or any(not 2 <= len(w) <= 60 for w in words):
        return lines.limit(0).withColumns({"said": F.lit(0), "len": F.lit(0), "tenth": F.lit(0), "slot": F.lit(0)})
    p = F.lit(word_pattern(words))
    d = lines.withColumn("len", F.max("t").over(Window.partitionBy("ep")))
    d = d if where is None else d.where(where)
    d = d.where(F.regexp_like("text", p)).withColumn("said", F.greatest(F.lit(1), F.regexp_count("text", p)))
    tenth = F.when(F.col("len") > 0, F.least(F.lit(9), F.floor(F.col("t") * 10 / F.col("len")))).otherwise(0)
    return d.withColumns({"tenth": tenth.cast("int"), "slot": F.least(F.lit(23), F.floor(F.col("t") / 300)).cast("int")})


def trend(rows: DataFrame) -> DataFrame:
    """Four groupings of matched lines in one pass: by year, series and speaker; by tenth; by slot; by episode and speaker.

    (set, year, series, spk, tenth, slot, ep, said, lines, t_min, t_max), columns outside a grouping null; set is grouping_id.
    """
    g = rows.groupBy("ep", "series", "year", "spk", "tenth", "slot").agg(F.sum("said").alias("said"), F.count(F.lit(1)).alias("lines"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    sets = [["year", "series", "spk"], ["series", "tenth"], ["series", "slot"], ["series", "ep", "spk"]]
    out = g.groupingSets([[F.col(c) for c in s] for s in sets], "year", "series", "spk", "tenth", "slot", "ep")
    sums = (F.sum("said").alias("said"), F.sum("lines").alias("lines"), F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"))
    return out.agg(F.grouping_id("year", "series", "spk", "tenth", "slot", "ep").alias("grouping"), *sums).select("grouping", "year", "series", "spk", "tenth", "slot", "ep", "said", "lines", "t_min", "t_max")


def dense(trended: DataFrame, column: str, size: int) -> DataFrame:
    """(series, counts): an array of ``size`` with the said counts of the grouping by ``column``, 0 where nothing was said."""
    rows = trended.where(F.col(column).isNotNull()).groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct(column, "said"))).alias("m"))
    return rows.select("series", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("counts"))


def first_last(rows: DataFrame) -> DataFrame:
    """(series, first_ep, first_t, last_ep, last_t) of matched lines, by date, then episode."""
    key = F.struct("date", "ep", "t", "id")
    return rows.groupBy("series").agg(F.min_by("ep", key).alias("first_ep"), F.min_by("t", key).alias("first_t"), F.max_by("ep", key).alias("last_ep"), F.max_by("t", key).alias("last_t"))


def top_episodes(rows: DataFrame, k: int = 40) -> DataFrame:
    """(series, ep, said, rank): the ``k`` episodes of a series that say it most; ties by episode."""
    e = rows.groupBy("series", "ep").agg(F.sum("said").alias("said"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("said"), "ep"))).where(F.col("rank") <= k)


def speaker_counts(lines: DataFrame, least: int = 20, k: int = 40) -> DataFrame:
    """(spk, n): the ``k`` speakers with most lines, from ``least`` on; ties by name."""
    return lines.where("spk != ''").groupBy("spk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "spk").limit(k)
