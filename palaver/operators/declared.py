"""Declarations ("a friend of the show"), what readers made of each, and the people declared.

Mentions are (ep, date, id, t, spk, phrase, quote), reads (ep, phrase, t, verdict, who: array, why), which people write by hand after reading a mention.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import phrase_key
from palaver.operators import folds, joins
from palaver.operators.pages import phrases_across_lines

SIDES = ("friend", "enemy", "acquaintance")
#: Verdicts that a reader may give; any other leaves a mention unread.
VERDICTS = (*SIDES, "not", "unclear")
CLIP = 260


def mentions(lines: DataFrame, phrase: str, hint: str, clip: int = CLIP) -> DataFrame:
    """(ep, date, id, t, spk, phrase, quote): each phrase of a line once; one that runs on into the next line is quoted with it."""
    found = phrases_across_lines(lines, phrase, hint).select("ep", "id", F.trim(phrase_key(F.col("phrase"))).alias("phrase"), "spans").groupBy("ep", "id", "phrase").agg(F.max("spans").alias("spans"))
    after = F.coalesce(F.lead("text").over(Window.partitionBy("ep").orderBy("t", "id")), F.lit(""))
    d = lines.withColumn("_after", after).select("ep", "date", "id", "t", "spk", "text", "_after")
    quote = F.when(F.col("spans"), F.concat_ws(" ", "text", "_after")).otherwise(F.col("text"))
    return d.join(found, ["ep", "id"]).select("ep", "date", "id", "t", "spk", "phrase", F.substring(quote, 1, clip).alias("quote"))


def numbered(rows: DataFrame, order: Sequence[str] = ("date", "ep", "t", "id", "phrase"), out: str = "n") -> DataFrame:
    """rows with their number in the order, from 0 and without gaps: by month of date, whose counts are summed first, so no task sees all rows."""
    r = rows.withColumn("_month", F.substring("date", 1, 7))
    before = r.groupBy("_month").agg(F.count(F.lit(1)).alias("_c"))  # a row a month
    before = before.select(F.col("_month").alias("_m"), (F.coalesce(F.sum("_c").over(Window.orderBy("_month")), F.lit(0)) - F.col("_c")).alias("_before"))
    j = r.join(F.broadcast(before), F.col("_month").eqNullSafe(F.col("_m")))
    # a sum may be null for all Spark knows; a number that may not be lets a plan that wants rows without one leave these out
    n = F.row_number().over(Window.partitionBy("_month").orderBy(*order)) - 1 + F.col("_before")
    return j.withColumn(out, n.cast("long")).drop("_month", "_m", "_before")


def judged(found: DataFrame, reads: DataFrame, lines: DataFrame, within: int = 20, reach: int = 2) -> DataFrame:
    """Numbered mentions with verdict, who, why and near, and reads that fit none, with n null.

    A mention and a read of its episode and phrase go together in order, as many as possible, then with the least shift, none over ``within`` seconds.
    Mentions without a valid read are "unread". ``near`` has the texts around those that are unread or unclear.
    """
    r = reads.withColumn("phrase", F.trim(phrase_key(F.col("phrase"))))
    r = r.withColumn("r", F.row_number().over(Window.partitionBy("ep", "phrase").orderBy("t", "verdict", "who", "why")).cast("long"))  # the same whenever it is worked out
    pairs = folds.align(found.select("ep", "phrase", "id", "t"), r.select("ep", "phrase", F.col("r").alias("id"), "t"), within).withColumnsRenamed({"m_id": "id", "r_id": "r"})
    got = pairs.join(r.select("ep", "phrase", "r", "verdict", "who", "why"), ["ep", "phrase", "r"]).drop("r")
    j = numbered(found).join(got, ["ep", "phrase", "id"], "left")
    verdict = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("unread")
    j = j.withColumns({"verdict": verdict, "why": F.coalesce("why", F.lit(""))})
    j = j.withColumn("who", F.when(F.col("verdict").isin(*SIDES), F.coalesce("who", F.array().cast("array<string>"))))
    around = joins.context(lines, found.select("ep", "id").distinct(), reach)
    j = j.join(around, ["ep", "id"], "left").withColumn("near", F.when(F.col("verdict").isin("unread", "unclear"), F.col("near")))
    left = r.join(pairs, ["ep", "phrase", "r"], "left_anti")
    cols = ["n", "ep", "date", "t", "spk", "phrase", "quote", "verdict", "who", "why", "near"]
    return j.select(*cols).unionByName(left.select("ep", "t", "phrase", "verdict", "who", "why"), allowMissingColumns=True)


def people(judged_: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(name, friend, enemy, acquaintance: arrays of numbers, both, why), by name: whoever is declared anything.

    Arrays are as long as people have read declarations by hand. why is what ``names`` (name, why) has, else that of the first declaration by date and time.
    """
    x = judged_.where(F.col("n").isNotNull() & F.col("verdict").isin(*SIDES)).select("n", "date", "t", "verdict", "why", F.explode(F.array_distinct("who")).alias("name"))
    own = [F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.col("n")))).alias(v) for v in SIDES]
    p = x.groupBy("name").agg(*own, F.min_by("why", F.struct("date", "t", "n")).alias("first"))
    if names is not None:
        p = p.join(names.select("name", F.col("why").alias("told")), "name", "left")
    else:
        p = p.withColumn("told", F.lit(None).cast("string"))
    both = (F.size("friend") > 0) & (F.size("enemy") > 0)
    return p.select("name", *SIDES, both.alias("both"), F.coalesce(F.nullif("told", F.lit("")), "first").alias("why"))


def stale(judged_: DataFrame) -> DataFrame:
    """(n): how many reads fit no mention any more."""
    return judged_.where(F.col("n").isNull()).agg(F.count(F.lit(1)).alias("n"))
