"""Tables as lines and episodes, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOSTS = ("view", "click")
#: Events as lines: a user is an episode, an hour a second; two event types stand for an unnamed and an unknown speaker.
LINES_SQL = """
lines AS (
  SELECT user_id AS ep, event_id AS id, CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352 AS t,
    CASE event_type WHEN 'error' THEN '' WHEN 'signup' THEN 'guest 1' ELSE event_type END AS spk,
    CAST(floor(value) AS BIGINT) % 40 AS words, CAST(length(event_type) AS BIGINT) AS chars,
    CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS series,
    CAST(2018 + user_id % 5 AS VARCHAR) || '-01-0' || CAST(1 + user_id % 9 AS VARCHAR) AS date,
    CASE WHEN user_id % 7 = 0 THEN 'Special' ELSE 'Main' END AS kind
  FROM events)"""
DURATIONS_SQL = LINES_SQL + """,
g AS (
  SELECT ep, t, count(*) AS n, sum(words) AS gw, sum(greatest(1, chars)) AS gc FROM lines GROUP BY ep, t),
h AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY ep ORDER BY t), t + 5) AS nxt FROM g),
dur AS (
  SELECT l.*, greatest(n::DOUBLE, least(20.0::DOUBLE, (nxt - l.t)::DOUBLE, gw::DOUBLE / 1.5::DOUBLE)) * greatest(1, chars) / gc AS dur
  FROM lines l JOIN h ON l.ep = h.ep AND l.t = h.t)"""
LENGTHS_SQL = DURATIONS_SQL + """,
lengths AS (SELECT ep, any_value(series) AS series, substr(any_value(date), 1, 4) AS year, arg_max(t + dur, row(t, id)) AS len FROM dur GROUP BY ep)"""
PERSON_SQL = "(spk <> '' AND NOT regexp_matches(spk, '(?i)^(guest|unknown)\\b'))"
TALK_SQL = DURATIONS_SQL + f""",
e AS (SELECT ep, arg_max(t + dur, row(t, id)) AS len FROM dur GROUP BY ep),
s AS (
  SELECT *, CASE WHEN {PERSON_SQL} AND spk IS DISTINCT FROM lag(spk) OVER (PARTITION BY ep ORDER BY t, id) THEN 1 ELSE 0 END AS st FROM dur),
talk AS (
  SELECT s.ep, spk, CAST(round(round(sum(dur), 6)) AS BIGINT) AS sec, CAST(sum(words) AS BIGINT) AS words, CAST(sum(st) AS BIGINT) AS turns,
    CAST(round(round(any_value(len), 6)) AS BIGINT) AS len, any_value(series) AS series, any_value(date) AS date, any_value(kind) AS kind, substr(any_value(date), 1, 4) AS year
  FROM s JOIN e ON s.ep = e.ep WHERE {PERSON_SQL} GROUP BY s.ep, spk HAVING round(sum(dur), 6) >= 30)"""
TURNS_SQL = LINES_SQL + """,
secs AS (
  SELECT *, greatest(1.0::DOUBLE, least((coalesce(lead(t) OVER w, t + 5) - t)::DOUBLE, greatest(20.0::DOUBLE, words / 1.5::DOUBLE))) AS sec,
    CASE WHEN row_number() OVER w > 1 AND lag(spk) OVER w = spk THEN 0 ELSE 1 END AS st
  FROM lines WINDOW w AS (PARTITION BY ep ORDER BY t, id)),
turned AS (SELECT *, CAST(sum(st) OVER (PARTITION BY ep ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM secs)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores where it comes in fewer partitions (one row group, say) than there are; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("ep"), F.col("event_id").alias("id"), (F.floor(F.unix_timestamp("ts") / 3600) - 473352).alias("t"),
        F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "signup", "guest 1").otherwise(F.col("event_type")).alias("spk"),
        (F.floor("value") % 40).alias("words"), F.length("event_type").cast("long").alias("chars"),
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("series"),
        F.concat((2018 + F.col("user_id") % 5).cast("string"), F.lit("-01-0"), (1 + F.col("user_id") % 9).cast("string")).alias("date"),
        F.when(F.col("user_id") % 7 == 0, "Special").otherwise("Main").alias("kind"),
    )


def talk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Talk rows with series, date, kind and year, which the episode's number alone gives here."""
    from palaver.operators.lines import talk

    t = talk(lines(spark, sf_dir))
    return t.withColumns({
        "series": F.when(F.col("ep") % 2 == 0, "even").otherwise("odd"), "date": F.concat((2018 + F.col("ep") % 5).cast("string"), F.lit("-01-0"), (1 + F.col("ep") % 9).cast("string")),
        "kind": F.when(F.col("ep") % 7 == 0, "Special").otherwise("Main"), "year": (2018 + F.col("ep") % 5).cast("string"),
    })
