"""Voices, joins near in time, names, topics and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import names
from palaver.operators import joins, talk, topics, voices
from palaver.plans.bindings import HOSTS, LENGTHS_SQL, LINES_SQL, lines, table
from palaver.plans.words import _M, messages

KINDS = (("(?i)red", "Warm"), ("(?i)blue|green", "Cold"))
TOPICS = (("small words", ("of", "de", "und"), 1.0), ("articles", ("the", "la", "der", "th*"), 0.5))


def _windows(s, d):
    e = table(s, d, "embeddings").where("embedding[0] > 0")
    return e.select((F.col("vec_id") % 3).alias("ep"), F.col("label"), F.col("vec_id").alias("win"), F.col("embedding").alias("emb"))


def _profiles(s, d):
    return table(s, d, "embeddings").where("embedding[0] <= 0").select(F.concat(F.lit("p"), (F.col("vec_id") % 7).cast("string")).alias("name"), F.col("embedding").alias("emb"))


def _episodes(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("20"), F.lpad((F.col("p_partkey") % 30).cast("string"), 2, "0"), F.lit("-01-02 "), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("#"), F.col("p_size").cast("string"), F.lit(" "))).otherwise(""), F.col("p_name")).alias("name"))


def _facts(s, d):
    return messages(s, d).where("spk != ''").select("ep", "id", "t", F.col("spk").alias("who"), topics.topic(F.col("text"), TOPICS).alias("topic"))


QUERIES = {
    "voice_topk_score": lambda s, d: voices.window_scores(_windows(s, d), _profiles(s, d)).select("ep", "label", "win", "name", F.round("score", 6).alias("score")),
    "voice_best_margin": lambda s, d: voices.best_names(voices.window_scores(_windows(s, d), _profiles(s, d)).withColumn("score", F.round("score", 6))),
    "voice_centroid_sim": lambda s, d: voices.similarities(voices.centroids(_profiles(s, d))),
    "window_sampling": lambda s, d: voices.sample_windows(lines(s, d).groupBy("ep", F.col("spk").alias("label")).agg(F.min("t").cast("double").alias("start"), F.max("t").cast("double").alias("end")), most=24),
    "nearest_line": lambda s, d: joins.nearest(lines(s, d).where("spk = 'view'").select("ep", "id", "t"), lines(s, d).where("spk = 'click'").select("ep", F.col("id").alias("r_id"), F.col("t").alias("r_t")), ["ep"], 10),
    "first_line_ahead": lambda s, d: joins.first_ahead(lines(s, d).where("spk = 'view'").select("ep", "id", "t"), lines(s, d).where("spk = 'click'").select("ep", F.col("id").alias("r_id"), F.col("t").alias("r_t")), ["ep"], 12),
    "prune_anti": lambda s, d: joins.pending(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), table(s, d, "orders").where("o_totalprice > 400000"), ["o_custkey"]),
    "upsert_episodes": lambda s, d: joins.upsert(table(s, d, "labels"), table(s, d, "labels").where("toxic = 1").withColumn("quality", F.lit(9)), ["doc_id"]),
    "carry_forward_speaker": lambda s, d: joins.carry_forward(lines(s, d), "ep", ["t", "id"], "spk").select("ep", "id", "spk"),
    "session_turns": lambda s, d: joins.sessions(lines(s, d).select("ep", F.col("t").cast("double").alias("start"), (F.col("t") + 2).cast("double").alias("end")), ["ep"], 1.0),
    "context_lines": lambda s, d: joins.context(messages(s, d), messages(s, d).where("text like '%,%'")).select("ep", "id", F.md5(F.array_join("near", "|")).alias("near")),
    "punctuation_gate": lambda s, d: joins.check_windows(messages(s, d), 14, 100, 9.0),
    "name_parts": lambda s, d: _episodes(s, d).select("id", names.date(F.col("name")).alias("date"), names.year(F.col("name")).alias("year"), names.number(F.col("name")).alias("number"), names.title(F.col("name")).alias("title")),
    "episode_kind": lambda s, d: _episodes(s, d).groupBy(names.kind(F.col("name"), KINDS).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "topic_of_text": lambda s, d: _facts(s, d).select("ep", "id", "topic"),
    "topic_share": lambda s, d: topics.shares(_facts(s, d)),
    "slot_positions": lambda s, d: topics.slots(_facts(s, d)),
    "median_by_period": lambda s, d: topics.medians(table(s, d, "orders").withColumn("year", F.substring(F.col("o_orderdate").cast("string"), 1, 4)), "year", "o_totalprice"),
    "rate_per_hour": lambda s, d: topics.per_hour(messages(s, d).where("spk = 'user'").groupBy("series", "year").agg(F.count(F.lit(1)).alias("n")), talk.hours(lines(s, d), HOSTS).where("spk is null").drop("spk"), ["series", "year"], 0.1),
    "minute_counter": lambda s, d: table(s, d, "events").groupBy("user_id", F.window("ts", "1 day")["start"].alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n > 3"),
}
_W = """w AS (SELECT vec_id % 3 AS ep, label, vec_id AS win, embedding AS e FROM embeddings WHERE embedding[1] > 0),
p AS (SELECT 'p' || CAST(vec_id % 7 AS VARCHAR) AS name, vec_id AS c, embedding AS e FROM embeddings WHERE embedding[1] <= 0)"""
_S = _W + """, d AS (SELECT ep, label, win, name, list_dot_product(CAST(w.e AS DOUBLE[]), CAST(p.e AS DOUBLE[])) AS x FROM w, p),
r AS (SELECT *, row_number() OVER (PARTITION BY win, name ORDER BY x DESC) AS k FROM d),
s AS (SELECT ep, label, win, name, round(avg(x), 6) AS score FROM r WHERE k <= 3 GROUP BY ALL)"""
_N = """n AS (SELECT p_partkey AS id, '20' || lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0') || '-01-02 ' || CASE WHEN p_partkey % 3 = 0 THEN '#' || p_size || ' ' ELSE '' END || p_name AS name FROM part)"""
_F = _M + r""", q AS (SELECT *, len(regexp_extract_all(text, '(?i)\b(?:of|de|und)\b')) AS a, 0.5 * len(regexp_extract_all(text, '(?i)\b(?:the|la|der|th\w*)\b')) AS b FROM m WHERE spk <> ''),
f AS (SELECT ep, id, t, spk AS who, CASE WHEN greatest(a, b) = 0 THEN 'Other' WHEN a >= b THEN 'small words' ELSE 'articles' END AS topic FROM q)"""
_NEAR = f"WITH {LINES_SQL}, v AS (SELECT ep, id, t FROM lines WHERE spk = 'view'), k AS (SELECT ep, id AS r_id, t AS r_t FROM lines WHERE spk = 'click'), "
ORACLES = {
    "voice_topk_score": f"WITH {_S} SELECT * FROM s",
    "voice_best_margin": f"""WITH {_S}, m AS (SELECT ep, label, name, round(median(score), 6) AS score FROM s GROUP BY ALL),
      k AS (SELECT *, row_number() OVER w AS rank, round(score - lead(score) OVER w, 6) AS margin FROM m WINDOW w AS (PARTITION BY ep, label ORDER BY score DESC, name)) SELECT ep, label, name, score, margin FROM k WHERE rank = 1""",
    "voice_centroid_sim": f"""WITH {_W}, u AS (SELECT name, generate_subscripts(e, 1) AS i, unnest(e)::DOUBLE AS x FROM p), c AS (SELECT name, i, avg(x) AS x FROM u GROUP BY ALL), v AS (SELECT name, list(x ORDER BY i) AS e FROM c GROUP BY name)
      SELECT a.name AS a, b.name AS b, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.name < b.name""",
    "window_sampling": f"""WITH {LINES_SQL}, t AS (SELECT ep, spk AS label, min(t) + 0.3::DOUBLE AS a, max(t) - 0.3::DOUBLE AS b FROM lines GROUP BY ALL), k AS (SELECT *, unnest(range(CAST(floor((b - a - 2.0::DOUBLE) / 4.0::DOUBLE) AS BIGINT) + 1)) AS k FROM t WHERE b - a >= 2),
      w AS (SELECT ep, label, a + k * 4.0::DOUBLE AS start, least(a + (k + 1) * 4.0::DOUBLE, b) AS "end", row_number() OVER (PARTITION BY ep, label ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY ep, label) AS n FROM k),
      z AS (SELECT * FROM w WHERE n <= 24 OR i IN (SELECT round_even(x * (n - 1) / 23.0::DOUBLE, 0) FROM range(24) g(x)))
      SELECT ep, label, CAST(row_number() OVER (PARTITION BY ep, label ORDER BY start) - 1 AS INTEGER) AS win, start, "end" FROM z""",
    "nearest_line": _NEAR + "j AS (SELECT v.*, r_id, r_t, row_number() OVER (PARTITION BY v.id ORDER BY abs(r_t - v.t), r_id) AS rn FROM v JOIN k ON v.ep = k.ep AND abs(v.t - r_t) <= 10) SELECT ep, id, t, r_id, r_t FROM j WHERE rn = 1",
    "first_line_ahead": _NEAR + "j AS (SELECT v.*, r_id, r_t, row_number() OVER (PARTITION BY v.id ORDER BY r_t, r_id) AS rn FROM v JOIN k ON v.ep = k.ep AND r_t BETWEEN v.t AND v.t + 12) SELECT ep, id, t, r_id, r_t FROM j WHERE rn = 1",
    "prune_anti": "SELECT c_custkey AS o_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "upsert_episodes": "SELECT doc_id, CASE WHEN toxic = 1 THEN 9 ELSE quality END AS quality, toxic FROM labels",
    "carry_forward_speaker": f"WITH {LINES_SQL} SELECT ep, id, coalesce(last_value(nullif(spk, '') IGNORE NULLS) OVER (PARTITION BY ep ORDER BY t, id ROWS UNBOUNDED PRECEDING), '') AS spk FROM lines",
    "session_turns": f"""WITH {LINES_SQL}, s AS (SELECT ep, id, t::DOUBLE AS start, (t + 2)::DOUBLE AS "end" FROM lines), g AS (SELECT *, CASE WHEN start - max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1 THEN 0 ELSE 1 END AS st FROM s WINDOW w AS (PARTITION BY ep ORDER BY start, "end")),
      r AS (SELECT *, sum(st) OVER (PARTITION BY ep ORDER BY start, "end") AS run FROM g) SELECT ep, min(start) AS start, max("end") AS "end", count(*) AS n FROM r GROUP BY ep, run""",
    "context_lines": f"WITH {_M}, c AS (SELECT ep, id, list(text) OVER (PARTITION BY ep ORDER BY t, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, text FROM m) SELECT ep, id, md5(array_to_string(near, '|')) AS near FROM c WHERE contains(text, ',')",
    "punctuation_gate": rf"""WITH {_M}, z AS (SELECT *, (t - min(t) OVER (PARTITION BY ep)) // 14 AS win FROM m), g AS (SELECT ep, win, CAST(sum(len(regexp_extract_all(text, '[^\s]+'))) AS BIGINT) AS words, CAST(sum(len(regexp_extract_all(text, '[.?!]'))) AS BIGINT) AS ends FROM z GROUP BY ALL)
      SELECT *, words < 100 OR ends * 100.0::DOUBLE / words >= 9 AS ok FROM g""",
    "name_parts": rf"""WITH {_N} SELECT id, left(name, 10) AS date, left(name, 4) AS year, regexp_extract(substr(name, 11), '^\s*#?(\d+)', 1) AS number, trim(regexp_replace(trim(substr(name, 11)), '^#?\d+\s*', '')) AS title FROM n""",
    "episode_kind": f"WITH {_N} SELECT CASE WHEN name LIKE '%red%' THEN 'Warm' WHEN name LIKE '%blue%' OR name LIKE '%green%' THEN 'Cold' ELSE 'Main' END AS kind, count(*) AS n FROM n GROUP BY ALL",
    "topic_of_text": f"WITH {_F} SELECT ep, id, topic FROM f",
    "topic_share": f"""WITH {_F}, n AS (SELECT who, topic, count(*) AS n FROM f GROUP BY ALL), g AS (SELECT *, sum(n) OVER (PARTITION BY who) AS g FROM n), o AS (SELECT *, sum(n) OVER (PARTITION BY topic) AS o, sum(n) OVER () AS everything FROM g WHERE g >= 20)
      SELECT who, topic, n, round(n / g, 6) AS share, round((n / g) / (o / everything), 6) AS lift FROM o""",
    "slot_positions": f"""WITH {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY t, id) AS slot, count(*) OVER (PARTITION BY ep) AS c FROM f) SELECT who, CAST(slot AS INTEGER) AS slot, count(*) AS n FROM r WHERE c = 4 GROUP BY ALL""",
    "median_by_period": "SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS median FROM orders GROUP BY ALL",
    "rate_per_hour": f"""WITH {LENGTHS_SQL}, {_M}, c AS (SELECT series, year, count(*) AS n FROM m WHERE spk = 'user' GROUP BY ALL), hh AS (SELECT series, year, round(sum(len) / 3600, 6) AS hours FROM lengths GROUP BY ALL)
      SELECT hh.series, hh.year, coalesce(n, 0) AS n, hours, CASE WHEN hours > 0 THEN round(coalesce(n, 0) / hours, 6) END AS rate, hours < 0.1 AS few FROM hh LEFT JOIN c ON hh.series = c.series AND hh.year = c.year""",
    "minute_counter": "SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 3",
}
