"""Leaderboards of runs, guests with their episodes, mentions in three groupings, and hosts' words against everyone else on their show."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import flow, style, talk, words
from palaver.plans.bindings import LINES_SQL, TALK_SQL, TURNS_SQL, talk_rows
from palaver.plans.upkeep import _PERSON, _TALKED, talked

HOSTS = {"en": ("ann", "bob"), "de": ("ann",)}
ITEMS = {"article": ("the", "la", "der"), "link": ("of", "and", "de")}


def _board(s, d):
    return flow.leaderboard(talked(s, d), ("ann", "bob"), "^[A-D]", 30, 30, 6.0, 3, 5, reading="src1[0-3]").withColumn("said", F.md5("said"))


def _guests(s, d):
    g = talk.guest_episodes(talk_rows(s, d), {"even": ("view",), "odd": ("click",)}, {"purchase": "Buyer"}, ("signup",), 60)
    return g.select("name", "count", F.array_join("shows", ",").alias("shows"), "first", "last", "talk", F.array_join(F.transform("eps", lambda e: F.concat_ws(":", e["date"], e["ep"].cast("string"), e["sec"].cast("string"))), ",").alias("eps"))


QUERIES = {
    "run_leaderboard": _board,
    "guest_episodes": _guests,
    "mention_cube": lambda s, d: words.mention_cube(talked(s, d).withColumn("year", F.substring("date", 1, 4)), ITEMS, HOSTS),
    "host_signatures": lambda s, d: style.host_signatures(style.within(talked(s, d), 30, 30), HOSTS, ("the", "and"), "or|sich", 10, 3, 1.1),
}
_OWN = "((series = 'en' AND spk IN ('ann', 'bob')) OR (series = 'de' AND spk = 'ann'))"
ORACLES = {
    "run_leaderboard": rf"""WITH {_TALKED}{TURNS_SQL.removeprefix(LINES_SQL)},
d AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY t, id) AS k, max(t) OVER (PARTITION BY ep) AS last, {_PERSON} AS person, regexp_matches(text, '^[A-D]') AS dash FROM turned),
b AS (SELECT ep, spk, min(k) AS a, max(k) AS z FROM d WHERE person GROUP BY ALL),
o AS (SELECT x.ep, x.spk, min(y.a) AS a, max(y.z) AS z FROM b x JOIN b y ON x.ep = y.ep AND x.spk <> y.spk GROUP BY ALL),
u AS (SELECT *, min(k) OVER (PARTITION BY ep, turn) AS i, max(k) OVER (PARTITION BY ep, turn) AS j, sum(CAST(dash AS INTEGER)) OVER (PARTITION BY ep, turn ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS piece FROM d),
r AS (SELECT series, CASE kind WHEN 'Main' THEN 'm' ELSE 'o' END AS grp, u.ep, u.spk, turn, piece, min(t) AS "at", sum(sec) AS raw, any_value(last) AS last, string_agg(text, ' ' ORDER BY k) AS txt
  FROM u JOIN o ON o.ep = u.ep AND o.spk = u.spk AND o.a < u.i AND o.z > u.j WHERE person AND NOT dash AND NOT regexp_matches(title, 'src1[0-3]') GROUP BY ALL),
f AS (SELECT series, grp, ep, spk, "at", CAST(round_even(round(raw, 6), 0) AS BIGINT) AS sec, md5(array_to_string(list_filter(regexp_split_to_array(txt, '\s+'), lambda w: w <> '')[1:14], ' ')) AS said FROM r WHERE round(raw, 6) >= 6 AND "at" >= 30 AND "at" <= last - 30),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY series, spk, grp ORDER BY sec DESC, ep, "at") <= 3)
SELECT * FROM t QUALIFY spk IN ('ann', 'bob') OR row_number() OVER (PARTITION BY series, spk IN ('ann', 'bob') ORDER BY sec DESC, ep, "at", spk) <= 5""",
    "guest_episodes": f"""WITH {TALK_SQL}, gg AS (SELECT CASE spk WHEN 'purchase' THEN 'Buyer' ELSE spk END AS name, * FROM talk WHERE NOT (series = 'even' AND spk = 'view') AND NOT (series = 'odd' AND spk = 'click') AND spk <> 'signup' AND sec >= 60)
      SELECT name, count(*) AS count, string_agg(DISTINCT series, ',' ORDER BY series) AS shows, min(date) AS first, max(date) AS last, CAST(sum(sec) AS BIGINT) AS talk, string_agg(date || ':' || ep || ':' || sec, ',' ORDER BY date, ep, series, sec) AS eps FROM gg GROUP BY name""",
    "mention_cube": rf"""WITH {_TALKED}, k AS (SELECT series, left(date, 4) AS year, spk, lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_'']+'))) AS w FROM lines),
      i AS (SELECT CASE WHEN w IN ('the', 'la', 'der') THEN 'article' ELSE 'link' END AS item, series, year, CASE WHEN {_PERSON} THEN spk ELSE 'Unknown' END AS spk, CASE WHEN {_OWN} THEN spk ELSE 'Others' END AS who FROM k WHERE w IN ('the', 'la', 'der', 'of', 'and', 'de'))
      SELECT item, series, year, spk, who, CAST(grouping(item, series, year, spk, who) AS BIGINT) AS grouping, count(*) AS n FROM i GROUP BY GROUPING SETS ((item, series, year), (item, series, year, spk), (series, who, year))""",
    "host_signatures": rf"""WITH {_TALKED}, z AS (SELECT *, max(t) OVER (PARTITION BY ep) AS last FROM lines),
      k AS (SELECT series, ep, CASE WHEN {_PERSON} THEN spk ELSE '' END AS spk, unnest(regexp_extract_all(regexp_replace(replace(lower(text), '’', ''''), '([a-z]) +''([a-z])', '\1''\2', 'g'), '[a-z]+(?:''[a-z]+)*')) AS word FROM z WHERE t >= 30 AND t <= last - 30),
      f AS (SELECT series, spk, word, sum(n)::DOUBLE AS y, count(*) AS eps FROM (SELECT series, ep, spk, word, count(*) AS n FROM k GROUP BY ALL) GROUP BY ALL), w AS (SELECT word, sum(y) AS prior FROM f GROUP BY word), a AS (SELECT sum(y) AS n_prior FROM f),
      m AS (SELECT * FROM f WHERE spk <> ''), v AS (SELECT series, word, sum(y) AS whole FROM m GROUP BY ALL), g AS (SELECT series, spk, sum(y) AS n_a FROM m GROUP BY ALL), h AS (SELECT *, sum(n_a) OVER (PARTITION BY series) AS n_show FROM g),
      j AS (SELECT m.*, whole - y AS y_b, n_a, n_show - n_a AS n_b, 1000.0::DOUBLE * prior / n_prior AS p FROM m JOIN v USING (series, word) JOIN h USING (series, spk) JOIN w USING (word), a
        WHERE {_OWN} AND y >= 10 AND eps >= 3 AND length(word) >= 3 AND word NOT IN ('the', 'and') AND NOT regexp_matches(word, '^(?:or|sich)')),
      q AS (SELECT series, spk, word, round((ln((y + p) / (n_a + 1000 - y - p)) - ln((y_b + p) / (n_b + 1000 - y_b - p))) / sqrt(1 / (y + p) + 1 / (y_b + p)), 6) AS z, CAST(y AS BIGINT) AS n, round((y / n_a) / (greatest(y_b, 0.5) / n_b), 6) AS lift FROM j)
      SELECT *, CAST(row_number() OVER (PARTITION BY series, spk ORDER BY z DESC, word) AS INTEGER) AS rank FROM q WHERE z > 0 AND lift >= 1.1 QUALIFY rank <= 40""",
}
