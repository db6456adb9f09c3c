"""Shows and what is known of them, voices and their names, announcements, and small rules as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions import text as fx
from palaver.operators import joins, shows, topics, voices
from palaver.plans.bindings import LINES_SQL, lines, table
from palaver.plans.misc import _F, TOPICS
from palaver.plans.pages import _B, _E
from palaver.plans.words import _M, messages

PEOPLE = {"Ann": ("la", "les"), "Bob": ("of", "de"), "Cy": ("the", "Der")}
_ALIAS = {n: "|".join(a) for n, a in PEOPLE.items()}


def _facts(s, d):
    m = messages(s, d).where("spk != ''").select("ep", "id", "t", F.col("spk").alias("who"), topics.topic(F.col("text"), TOPICS).alias("fact"))
    return m.select("ep", F.col("id").alias("n"), "t", "who", "fact", F.when(F.col("fact") == "articles", "my").otherwise("guess").alias("src"))


def _labels(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Names of voices, a row an episode and label: found for most, given by hand for some."""
    v = lines(s, d).select("ep", F.col("spk").alias("label")).distinct()
    auto = v.withColumn("name", F.when(F.length("label") > 4, F.concat(F.lit("auto "), "label")))
    return auto, v.where("label = 'click' OR label = 'signup'").withColumn("name", F.concat(F.lit("hand "), F.col("ep").cast("string")))


def _voices(s: SparkSession, d: str) -> DataFrame:
    """Vectors as voices: three episodes, a name where the first component is positive."""
    e = table(s, d, "embeddings").where("label IS NOT NULL")
    return e.select((F.col("vec_id") % 3).alias("ep"), F.col("vec_id").alias("label"), F.when(F.element_at("embedding", 1) > 0, F.concat(F.lit("p"), F.col("label").cast("string"))).alias("name"), F.col("embedding").alias("emb"), (F.col("vec_id") % 400).cast("double").alias("sec"))


def _fold(s, d):
    v = _voices(s, d)
    f = voices.fold(v.where("name IS NULL").select("ep", "label", "emb"), v.where("name IS NOT NULL").select("ep", "name", "emb"), 0.3, 0.02)
    return f.select("ep", "label", "into", F.round("sim", 6).alias("sim"))


def _second(s, d):
    best = _voices(s, d).where("name IS NOT NULL").select("ep", "label", "name", F.round(F.abs(F.element_at("emb", 2)), 6).alias("score"), F.round(F.abs(F.element_at("emb", 3)), 6).alias("margin"), "sec")
    return voices.second_chance(best, ("p1", "p2", "p3", "p4"), s.createDataFrame([(0, "p1"), (1, "p2")], "ep long, name string"), 0.05, 0.05).select("ep", "label", "name", "score")


def _guess(s, d):
    e = lines(s, d).where("spk != ''").groupBy("ep", F.col("spk").alias("label")).agg(F.sum("words").alias("sec"))
    v = e.select("ep", "label", "sec", F.when(F.col("label") == "view", "Host").alias("name"), F.when(F.col("label") == "view", F.when(F.col("ep") % 2 == 0, "voiceprint").otherwise("hand")).alias("source"))
    c = e.where("sec > 40").select("ep", F.concat(F.lit("Guest "), F.length("label").cast("string")).alias("name"), F.col("sec").alias("score")).distinct()
    host = e.where("label = 'purchase' AND sec > 200").select("ep", F.lit("Host").alias("name"), F.lit(100_000).cast("long").alias("score"))
    return v, c.unionByName(host)


def _asr(s, d):
    m = messages(s, d)
    piece = F.struct(F.struct((F.col("t") * 1000 + 250).alias("from"), (F.col("t") * 1000 + 5500).alias("to")).alias("offsets"), F.when(F.col("id") == 2, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("text"))).alias("text"))
    g = m.groupBy("ep").agg(F.to_json(F.struct(F.array_sort(F.collect_list(piece), lambda a, b: a["offsets"]["from"].cast("int") - b["offsets"]["from"].cast("int")).alias("transcription"))).alias("content"))
    return shows.recognised(g.select(F.col("ep").cast("string").alias("path"), "content"))


def _moves(s, d):
    c = messages(s, d).select(F.col("ep").cast("string").alias("path"), (F.col("t") + 0.537).alias("start"), F.col("spk").alias("label"))
    m = messages(s, d).where("length(text) < 60").select(F.col("ep").cast("string").alias("path"), (F.col("t") * 1000 + 537).alias("ms"), F.lit("moved").alias("label"))
    return shows.moved(c, m).select("path", F.round("start", 3).alias("start"), "label")


def _named(s, d):
    return shows.named(lines(s, d).select("ep", "id", F.col("spk").alias("label")), *_labels(s, d)).select("ep", "id", "spk", "src")


def _described(s, d):
    e = lines(s, d).select("ep").distinct()
    t = table(s, d, "documents").select(F.col("doc_id").alias("ep"), F.md5("text").alias("description"))
    return shows.described(e, t)


def _announced(s, d):
    m = messages(s, d)
    return m.select("ep", "id", fx.last_named(F.col("text"), PEOPLE).alias("last"), fx.announced(F.col("text"), F.when(F.col("spk") == "user", "Bob").otherwise(F.col("spk")), PEOPLE, r"(?iuU)\b(?:in|et) (?:la|de|of)\b").alias("who"))


def _handed(s, d):
    c = table(s, d, "customer")
    line = F.concat(F.lit("and that is "), F.element_at(F.array(*map(F.lit, ("Mary", "Ann", "Okay", "mary", "Zed"))), (F.col("c_custkey") % 5 + 1).cast("int")), F.lit(" with it"))
    text = F.when(F.col("c_nationkey") < 12, "Mary de Cruz joins us, Zed too").otherwise(F.lit(None).cast("string"))
    return c.select(F.col("c_custkey").alias("id"), fx.handed_to(line, text, {"Ann": ("Ann",)}, r"\bthat is ([A-Z][a-z]+)\b", ("Okay",)).alias("guest"))


def _rules(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("SPEAKER_"), F.lpad((k % 12).cast("string"), 2, "0")))
    stamp = F.map_from_arrays(F.array(F.lit("q"), F.lit("by")), F.array("p_name", F.col("p_size").cast("string")))
    return p.select(k.alias("id"), fx.voice_label(raw).alias("label"), fx.cache_key(k, stamp).alias("key"), fx.search_terms(F.split("p_name", " ")).alias("terms"), fx.half_even(F.col("p_size") / 2.0).cast("long").alias("half"))


def _layout(s, d):
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_acctbal", T.IntegerType()), T.StructField("note", T.StringType())])
    return shows.conformed(table(s, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,0)").cast("string")), schema)


def _overridden(s, d):
    f = _facts(s, d)
    o = f.where("n = 2").select("ep", "n", F.when(F.col("fact") == "articles", "by hand").alias("fact"))
    return shows.overridden(f, o, 1).select("ep", "n", "fact")


QUERIES = {
    "named_lines": _named,
    "sentence_moves": _moves,
    "known_descriptions": _described,
    "show_hosts": lambda s, d: shows.with_hosts(lines(s, d).select("ep", "kind").distinct(), s.createDataFrame([("Main", "view"), ("Main", "click")], "key string, host string"), "kind").select("ep", "kind", F.array_join("hosts", ",").alias("hosts")),
    "one_episode": lambda s, d: shows.one_episode(lines(s, d), ep=7, kind="Special").select("id", "t"),
    "episode_list": lambda s, d: shows.episode_list(lines(s, d), lines(s, d).select("ep", "date").distinct()),
    "facts_nested": lambda s, d: shows.nested(_facts(s, d)).select("ep", F.size("facts").alias("n"), F.element_at("facts", -1)["fact"].alias("last")),
    "facts_flat": lambda s, d: shows.flat(shows.nested(_facts(s, d)).join(messages(s, d).select("ep", "date").distinct(), "ep")).select("ep", "date", "n", "who", "fact"),
    "facts_overridden": _overridden,
    "worth_a_try": lambda s, d: shows.worth_a_try(lines(s, d).select("ep").distinct(), table(s, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("ep")), ["ep"], 8),
    "regulars_enrolled": lambda s, d: shows.covers(lines(s, d), "ep", "spk", ("view", "click", "purchase")),
    "stop_words": lambda s, d: shows.all_stop_words(*[table(s, d, "part").select(F.element_at(F.split("p_name", " "), i).alias("word")) for i in (1, 2)]),
    "recognised_speech": lambda s, d: _asr(s, d).select("path", "start", "end", F.md5("text").alias("text")),
    "conformed_layout": _layout,
    "backfilled_names": lambda s, d: shows.backfilled(_labels(s, d)[1], _labels(s, d)[0], ["ep", "label"]),
    "speech_seconds": lambda s, d: voices.speech_seconds(lines(s, d).select("ep", F.col("spk").alias("label"), F.col("t").alias("start"), (F.col("t") + 2 + F.col("id") % 3).alias("end"))),
    "loud_windows": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(fx.loudness(F.col("embedding")), 6).alias("rms")).where("rms >= 0.005"),
    "fold_voices": _fold,
    "second_chance": _second,
    "guessed_guests": lambda s, d: voices.guess_guests(*_guess(s, d), 60),
    "guests_redone": lambda s, d: voices.redo_guests(_guess(s, d)[0].withColumns({"name": F.when(F.length("label") > 6, "old").otherwise(F.col("name")), "source": F.when(F.length("label") > 6, "guess").otherwise(F.col("source"))}), _guess(s, d)[1], 60).select("ep", "label", "name", "source"),
    "announced_names": _announced,
    "handed_to": _handed,
    "carry_word_speaker": lambda s, d: joins.carry_forward(joins.carry_forward(lines(s, d).withColumn("at", F.when(F.col("words") > 20, F.col("t").cast("string"))), "ep", ["t", "id"], "spk"), "ep", ["t", "id"], "at").select("id", "spk", "at"),
    "small_rules": _rules,
}
_FX = _F + ", ff AS (SELECT ep, id AS n, t, who, topic AS fact, CASE WHEN topic = 'articles' THEN 'my' ELSE 'guess' END AS src FROM f)"
_V = f"WITH {LINES_SQL}, v AS (SELECT DISTINCT ep, spk AS label FROM lines), a AS (SELECT ep, label, CASE WHEN length(label) > 4 THEN 'auto ' || label END AS name FROM v), b AS (SELECT ep, label, 'hand ' || CAST(ep AS VARCHAR) AS name FROM v WHERE label IN ('click', 'signup'))"
_VEC = "WITH v AS (SELECT vec_id % 3 AS ep, vec_id AS label, CASE WHEN embedding[1] > 0 THEN 'p' || CAST(label AS VARCHAR) END AS name, embedding AS e, CAST(vec_id % 400 AS DOUBLE) AS sec FROM embeddings WHERE label IS NOT NULL)"
_G = f"""WITH {LINES_SQL}, e AS (SELECT ep, spk AS label, CAST(sum(words) AS BIGINT) AS sec FROM lines WHERE spk <> '' GROUP BY ALL),
  v AS (SELECT *, CASE WHEN label = 'view' THEN 'Host' END AS name, CASE WHEN label = 'view' THEN CASE WHEN ep % 2 = 0 THEN 'voiceprint' ELSE 'hand' END END AS source FROM e),
  c AS (SELECT ep, name, row_number() OVER (PARTITION BY ep ORDER BY score DESC, name) AS k, count(*) OVER (PARTITION BY ep) AS m FROM (SELECT DISTINCT ep, 'Guest ' || CAST(length(label) AS VARCHAR) AS name, sec AS score FROM e WHERE sec > 40 UNION ALL SELECT ep, 'Host', 100000 FROM e WHERE label = 'purchase' AND sec > 200) q
    WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.ep = q.ep AND v.name = q.name)),
  o AS (SELECT ep, label, row_number() OVER (PARTITION BY ep ORDER BY sec DESC, label) AS k, count(*) OVER (PARTITION BY ep) AS n FROM v WHERE name IS NULL AND sec >= 60),
  w AS (SELECT ep, bool_and(name IS NULL OR source = 'voiceprint') AS known FROM v WHERE sec >= 60 GROUP BY ep),
  g AS (SELECT o.ep, o.label, c.name, CASE WHEN n = 1 AND m = 1 AND known THEN 'sure' ELSE 'guess' END AS source FROM o JOIN c ON o.ep = c.ep AND o.k = c.k JOIN w ON w.ep = o.ep)"""


def _last(text: str) -> str:
    at = lambda a: rf"CASE WHEN regexp_matches({text}, '{_B}(?:{a}){_E}') THEN length(regexp_extract({text}, '(?s)^(.*{_B})(?:{a}){_E}', 1)) ELSE -1 END"
    x, y, z = (at(a) for a in _ALIAS.values())
    return f"CASE WHEN greatest({x}, {y}, {z}) = -1 THEN '' WHEN {x} = greatest({x}, {y}, {z}) THEN 'Ann' WHEN {y} = greatest({x}, {y}, {z}) THEN 'Bob' ELSE 'Cy' END"


ORACLES = {
    "named_lines": f"""{_V} SELECT l.ep, l.id, coalesce(b.name, a.name, '') AS spk, CASE WHEN b.name IS NOT NULL THEN 'hand' WHEN a.name IS NOT NULL THEN 'auto' ELSE '' END AS src
      FROM lines l LEFT JOIN a ON a.ep = l.ep AND a.label = l.spk LEFT JOIN b ON b.ep = l.ep AND b.label = l.spk""",
    "sentence_moves": f"WITH {_M} SELECT CAST(ep AS VARCHAR) AS path, round(t + 0.537::DOUBLE, 3) AS start, CASE WHEN length(text) < 60 THEN 'moved' ELSE spk END AS label FROM m",
    "known_descriptions": f"WITH {LINES_SQL} SELECT e.ep, coalesce(md5(text), '') AS description FROM (SELECT DISTINCT ep FROM lines) e LEFT JOIN documents ON doc_id = e.ep",
    "show_hosts": f"WITH {LINES_SQL} SELECT DISTINCT ep, kind, CASE kind WHEN 'Main' THEN 'click,view' ELSE '' END AS hosts FROM lines",
    "one_episode": f"WITH {LINES_SQL} SELECT id, t FROM lines WHERE ep = 7 AND kind = 'Special'",
    "episode_list": f"WITH {LINES_SQL} SELECT ep, date, max(t) AS last FROM lines GROUP BY ALL",
    "facts_nested": f"WITH {_FX} SELECT ep, CAST(count(*) AS INTEGER) AS n, arg_max(fact, n) AS last FROM ff GROUP BY ep",
    "facts_flat": f"WITH {_FX} SELECT ff.ep, date, n, who, fact FROM ff JOIN (SELECT DISTINCT ep, date FROM m) USING (ep)",
    "facts_overridden": f"""WITH {_FX}, s AS (SELECT DISTINCT ep FROM ff WHERE n = 2 AND fact <> 'articles'), w AS (SELECT ep FROM ff WHERE ep IN (SELECT ep FROM s) GROUP BY ep HAVING count(*) FILTER (WHERE src = 'my') < 1)
      SELECT ep, n, CASE WHEN n = 2 AND fact = 'articles' THEN 'by hand' ELSE fact END AS fact FROM ff WHERE ep NOT IN (SELECT ep FROM w)""",
    "worth_a_try": "SELECT user_id AS ep FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error') < 8",
    "regulars_enrolled": f"WITH {LINES_SQL} SELECT ep, count(DISTINCT spk) FILTER (WHERE spk IN ('view', 'click', 'purchase')) = 3 AS \"all\" FROM lines GROUP BY ep",
    "stop_words": "SELECT DISTINCT lower(w) AS word FROM (SELECT string_split(p_name, ' ')[1] AS w FROM part UNION ALL SELECT string_split(p_name, ' ')[2] FROM part)",
    "recognised_speech": f"WITH {_M} SELECT CAST(ep AS VARCHAR) AS path, (t * 1000 + 250) / 1000.0::DOUBLE AS start, (t * 1000 + 5500) / 1000.0::DOUBLE AS \"end\", md5(trim(text)) AS text FROM m WHERE id <> 2 AND trim(text) <> ''",
    "conformed_layout": "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, TRY_CAST(CAST(CAST(c_acctbal AS DECIMAL(12,0)) AS VARCHAR) AS INTEGER) AS c_acctbal, CAST(NULL AS VARCHAR) AS note FROM customer",
    "backfilled_names": f"{_V} SELECT * FROM b UNION ALL SELECT a.* FROM a WHERE (ep, label) NOT IN (SELECT (ep, label) FROM b)",
    "speech_seconds": f"WITH {LINES_SQL} SELECT ep, spk AS label, CAST(sum(2 + id % 3) AS BIGINT) AS sec FROM lines GROUP BY ALL",
    "loud_windows": "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / len(embedding)), 6) AS rms FROM embeddings WHERE sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / len(embedding)) >= 0.005",
    "fold_voices": f"""{_VEC}, b AS (SELECT u.ep, u.label, k.name AS "into", max(list_dot_product(CAST(u.e AS DOUBLE[]), CAST(k.e AS DOUBLE[]))) AS sim FROM v u JOIN v k ON u.ep = k.ep WHERE u.name IS NULL AND k.name IS NOT NULL GROUP BY ALL),
      r AS (SELECT *, row_number() OVER w AS k, sim - lead(sim) OVER w AS gap FROM b WINDOW w AS (PARTITION BY ep, label ORDER BY sim DESC, "into")) SELECT ep, label, "into", round(sim, 6) AS sim FROM r WHERE k = 1 AND sim >= 0.3 AND coalesce(gap, 1) >= 0.02""",
    "second_chance": f"""{_VEC}, s AS (SELECT ep, label, name, round(abs(e[2]), 6)::DOUBLE AS score, round(abs(e[3]), 6)::DOUBLE AS margin, sec FROM v WHERE name IN ('p1', 'p2', 'p3', 'p4')),
      r AS (SELECT *, row_number() OVER (PARTITION BY ep, name ORDER BY score DESC, label) AS k FROM s WHERE score >= 0.05 AND margin >= 0.05 AND sec >= 120 AND NOT (ep = 0 AND name = 'p1') AND NOT (ep = 1 AND name = 'p2')) SELECT ep, label, name, score FROM r WHERE k = 1""",
    "guessed_guests": f"{_G} SELECT * FROM g",
    "guests_redone": f"{_G} SELECT v.ep, v.label, coalesce(g.name, v.name) AS name, coalesce(g.source, v.source) AS source FROM v LEFT JOIN g ON g.ep = v.ep AND g.label = v.label",
    "announced_names": rf"WITH {_M} SELECT ep, id, {_last('text')} AS last, CASE WHEN spk = 'user' AND regexp_matches(text, '(?i){_B}(?:in|et) (?:la|de|of){_E}') THEN 'Bob' ELSE {_last('text')} END AS who FROM m",
    "handed_to": "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN CASE WHEN c_nationkey < 12 THEN 'Mary de Cruz' ELSE 'Mary' END WHEN 4 THEN 'Zed' ELSE '' END AS guest FROM customer",
    "carry_word_speaker": f"""WITH {LINES_SQL} SELECT id, coalesce(last_value(nullif(spk, '') IGNORE NULLS) OVER w, '') AS spk, coalesce(last_value(CASE WHEN words > 20 THEN CAST(t AS VARCHAR) END IGNORE NULLS) OVER w, '') AS at FROM lines
      WINDOW w AS (PARTITION BY ep ORDER BY t, id ROWS UNBOUNDED PRECEDING)""",
    "small_rules": r"""WITH w AS (SELECT *, list_distinct(string_split(lower(p_name), ' ')) AS u, string_split(lower(p_name), ' ') AS o FROM part),
      x AS (SELECT *, list_filter(o, lambda a, i: list_position(o, a) = i AND len(list_filter(u, lambda b: b <> a AND starts_with(a, b))) = 0) AS t FROM w)
      SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '[Speaker ' || CAST(p_partkey % 12 + 1 AS VARCHAR) || '] ' END AS label, sha1(CAST(p_partkey AS VARCHAR) || '&by=' || CAST(p_size AS VARCHAR) || '&q=' || p_name) AS key,
        array_to_string(t[1:5], ' | ') AS terms, CAST(round_even(p_size / 2.0::DOUBLE, 0) AS BIGINT) AS half FROM x""",
}
