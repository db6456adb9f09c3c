"""Talk time, turns, hand-overs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import flow, lines, talk
from palaver.plans.bindings import DURATIONS_SQL, HOSTS, LENGTHS_SQL, PERSON_SQL, TALK_SQL, TURNS_SQL, talk_rows
from palaver.plans.bindings import lines as bound

_HOSTS = "('view', 'click')"
QUERIES = {
    "line_durations": lambda s, d: lines.durations(bound(s, d)).select("ep", "id", "t", "spk", F.round("dur", 6).alias("dur")),
    "line_seconds": lambda s, d: lines.line_seconds(bound(s, d)).select("ep", "id", F.round("sec", 6).alias("sec")),
    "turn_numbers": lambda s, d: lines.turns(bound(s, d)).select("ep", "id", "spk", "turn"),
    "talk_time": lambda s, d: lines.talk(bound(s, d)),
    "guest_table": lambda s, d: talk.guests(talk_rows(s, d), HOSTS),
    "lineup_present": lambda s, d: talk.lineup(talk_rows(s, d), HOSTS).select("ep", F.array_join("hosts", ",").alias("hosts"), F.array_join("guests", ",").alias("guests")),
    "lineup_subs": lambda s, d: talk.substitutes(talk.lineup(talk_rows(s, d), HOSTS, 60), ("view", "click", "nobody")),
    "hours_by_year": lambda s, d: talk.hours(bound(s, d), HOSTS),
    "talk_shares": lambda s, d: talk.shares(talk_rows(s, d)),
    "headline_summary": lambda s, d: talk.summary(talk_rows(s, d), lines.lengths(lines.durations(bound(s, d))), HOSTS),
    "handover_grid": lambda s, d: flow.handovers(bound(s, d), HOSTS, ("series",)),
    "handover_share": lambda s, d: flow.handover_shares(flow.handovers(bound(s, d), HOSTS, ("series",)), ("series",)),
    "longest_runs": lambda s, d: flow.longest_runs(bound(s, d), start=10, end=6, least=8.0),
}
_GRID = f"""
p AS (SELECT ep, series, turn, any_value(spk) AS spk FROM turned GROUP BY ep, series, turn),
q AS (SELECT *, lead(spk) OVER (PARTITION BY ep ORDER BY turn) AS nxt FROM p),
grid AS (
  SELECT series, CASE WHEN spk IN {_HOSTS} THEN spk ELSE 'Guest' END AS "from", CASE WHEN nxt IN {_HOSTS} THEN nxt ELSE 'Guest' END AS "to", count(*) AS n
  FROM q WHERE {PERSON_SQL} AND {PERSON_SQL.replace("spk", "nxt")} GROUP BY ALL)"""
ORACLES = {
    "line_durations": f"WITH {DURATIONS_SQL} SELECT ep, id, t, spk, round(dur, 6) AS dur FROM dur",
    "line_seconds": f"WITH {TURNS_SQL} SELECT ep, id, round(sec, 6) AS sec FROM turned",
    "turn_numbers": f"WITH {TURNS_SQL} SELECT ep, id, spk, turn FROM turned",
    "talk_time": f"WITH {TALK_SQL} SELECT ep, spk, sec, words, turns, len FROM talk",
    "guest_table": f"""WITH {TALK_SQL} SELECT spk AS name, count(*) AS count, string_agg(DISTINCT series, ',' ORDER BY series) AS all_series, min(date) AS first, max(date) AS last,
      CAST(sum(sec) AS BIGINT) AS talk FROM talk WHERE spk NOT IN {_HOSTS} AND sec >= 60 GROUP BY spk""",
    "lineup_present": f"""WITH {TALK_SQL} SELECT ep, coalesce(string_agg(spk, ',' ORDER BY CASE spk WHEN 'view' THEN 0 ELSE 1 END) FILTER (WHERE spk IN {_HOSTS}), '') AS hosts,
      coalesce(string_agg(spk, ',' ORDER BY spk) FILTER (WHERE spk NOT IN {_HOSTS}), '') AS guests FROM talk WHERE sec >= 120 GROUP BY ep""",
    "lineup_subs": f"""WITH {TALK_SQL}, t AS (SELECT * FROM talk WHERE sec >= 60)
      SELECT g.spk AS guest, h.host, count(*) AS n FROM t g, (VALUES ('view'), ('click'), ('nobody')) h(host)
      WHERE g.spk NOT IN ('view', 'click', 'nobody') AND NOT EXISTS (SELECT 1 FROM t x WHERE x.ep = g.ep AND x.spk = h.host) AND g.spk NOT IN {_HOSTS} GROUP BY ALL""",
    "hours_by_year": f"""WITH {LENGTHS_SQL} SELECT series, substr(date, 1, 4) AS year, spk, round(sum(dur) / 3600, 6) AS hours FROM dur WHERE spk IN {_HOSTS} GROUP BY ALL
      UNION ALL SELECT series, year, NULL, round(sum(len) / 3600, 6) FROM lengths GROUP BY ALL""",
    "talk_shares": f"""WITH {TALK_SQL} SELECT spk, year, round(avg(CASE WHEN len > 0 THEN sec / len END), 6) AS share, round(sum(words) * 60.0::DOUBLE / sum(sec), 6) AS wpm,
      round(sum(sec) / nullif(sum(turns), 0), 6) AS turn_sec FROM talk GROUP BY spk, year""",
    "headline_summary": f"""WITH {TALK_SQL}, p AS (
        SELECT e.ep, CAST(round(round(any_value(e.len), 6)) AS BIGINT) AS len, sum(CASE WHEN spk IN {_HOSTS} THEN sec ELSE 0 END) AS own FROM e LEFT JOIN talk ON e.ep = talk.ep GROUP BY e.ep),
      z AS (SELECT spk, sum(sec) AS s, count(*) AS n FROM talk GROUP BY spk)
      SELECT count(*) AS episodes, round(sum(len) / 3600, 6) AS hours, round(avg(CASE WHEN len > 0 THEN own / len END), 6) AS host_share, median(len) AS median_len,
        (SELECT arg_max(spk, row(s, spk)) FROM z) AS most_talk, (SELECT arg_max(spk, row(n, spk)) FROM z) AS most_episodes FROM p""",
    "handover_grid": f"WITH {TURNS_SQL}, {_GRID} SELECT * FROM grid",
    "handover_share": f"""WITH {TURNS_SQL}, {_GRID}, o AS (SELECT *, sum(n) OVER (PARTITION BY series, "from") AS own, sum(n) OVER (PARTITION BY series) AS everything FROM grid)
      SELECT series, "from", "to", n, round(n / own, 6) AS share FROM o WHERE own >= 0.01 * everything""",
    "longest_runs": f"""WITH {TURNS_SQL}, m AS (SELECT ep, max(t) AS last FROM lines GROUP BY ep),
      r AS (SELECT ep, turn, any_value(spk) AS spk, min(t) AS begins, sum(sec) AS sec, count(*) AS lines FROM turned GROUP BY ep, turn),
      f AS (SELECT r.* FROM r JOIN m ON r.ep = m.ep WHERE {PERSON_SQL} AND round(sec, 6) >= 8 AND begins >= 10 AND begins + sec <= last - 6
        AND EXISTS (SELECT 1 FROM r b WHERE b.ep = r.ep AND b.turn < r.turn AND b.spk <> r.spk AND {PERSON_SQL.replace("spk", "b.spk")})
        AND EXISTS (SELECT 1 FROM r a WHERE a.ep = r.ep AND a.turn > r.turn AND a.spk <> r.spk AND {PERSON_SQL.replace("spk", "a.spk")})),
      k AS (SELECT *, row_number() OVER (PARTITION BY spk ORDER BY round(sec, 6) DESC, ep, begins) AS rank FROM f)
      SELECT ep, spk, begins, round(sec, 6) AS sec, lines, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 12""",
}
