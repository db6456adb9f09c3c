"""Words, phrases, the word tracker and style."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text as fx
from palaver.operators import style, words
from palaver.plans.bindings import spread, table

WORDS = ("the", "la", "der", "of the", "que")
LEVELS = {"strict": ("the",), "wide": ("of", "de"), "loose": ("and", "la", "und")}
ITEMS = {"article": ("the", "la", "der"), "link": ("of", "and", "de")}


def messages(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations")
    year = (2018 + F.col("conv_id") % 5).cast("string")
    return c.select(F.col("conv_id").alias("ep"), F.col("turn").alias("id"), (F.col("turn") * 7).alias("t"), F.when(F.col("role") == "system", "").otherwise(F.col("role")).alias("spk"), "text", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("series"), year.alias("year"), F.concat(year, F.lit("-01-01")).alias("date"))


def texts(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select(F.col("doc_id").alias("ep"), F.col("source").alias("person"), (2018 + F.col("doc_id") % 5).cast("string").alias("year"), "text"))


def _trend(s, d):
    return words.matched(messages(s, d), ("the", "la"))


QUERIES = {
    "phrase_counts": lambda s, d: words.phrase_counts(messages(s, d), WORDS),
    "phrase_counts_of_documents": lambda s, d: words.phrase_counts(texts(s, d).withColumn("spk", F.col("person")), WORDS, ("year", "spk")),
    "hit_levels": lambda s, d: words.hit_levels(messages(s, d), LEVELS, ("of the",)),
    "mentions_by_year": lambda s, d: words.mentions(messages(s, d), ITEMS, ("series", "year"), ("user",)),
    "trend_rows": lambda s, d: words.trend(_trend(s, d)),
    "trend_tenths": lambda s, d: words.dense(words.trend(_trend(s, d)), "tenth", 10).select("series", F.array_join("counts", ",").alias("counts")),
    "trend_slots": lambda s, d: words.dense(words.trend(_trend(s, d)), "slot", 24).select("series", F.array_join("counts", ",").alias("counts")),
    "trend_first_last": lambda s, d: words.first_last(_trend(s, d)),
    "trend_top_episodes": lambda s, d: words.top_episodes(_trend(s, d), 10),
    "speaker_counts": lambda s, d: words.speaker_counts(messages(s, d)),
    "token_freq": lambda s, d: style.frequencies(style.token_counts(texts(s, d)), "person"),
    "log_odds_signature": lambda s, d: style.signatures(style.token_counts(texts(s, d)), least=10, episodes=3),
    "vocab_ttr": lambda s, d: style.vocabulary(texts(s, d)),
    "fragments": lambda s, d: style.fragments(messages(s, d)),
    "all_words_search": lambda s, d: texts(s, d).where(fx.contains_all(F.col("text"), "the ONE of")).select("ep", "person"),
    "word_totals": lambda s, d: messages(s, d).select("ep", "id", fx.count_words(F.col("text")).cast("long").alias("words"), F.md5(fx.words_only(F.col("text"))).alias("bare")),
}

_M = """m AS (
  SELECT conv_id AS ep, turn AS id, turn * 7 AS t, CASE WHEN role = 'system' THEN '' ELSE role END AS spk, text,
    CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS series, CAST(2018 + conv_id % 5 AS VARCHAR) AS year,
    CAST(2018 + conv_id % 5 AS VARCHAR) || '-01-01' AS date FROM conversations)"""
_X = "x AS (SELECT doc_id AS ep, source AS person, CAST(2018 + doc_id % 5 AS VARCHAR) AS year, text FROM documents)"


def _pattern(ws) -> str:
    one = "|".join(w.replace(" ", r"[\s-]+") for w in sorted(ws, key=lambda w: (-len(w), w)))
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_''])({one})(?:$|[^\p{{L}}\p{{N}}_''])"


def _all(text: str, ws) -> str:
    """SQL without look-around: every character that may bound a match is doubled, and matches consume their bounds."""
    return rf"regexp_extract_all(regexp_replace({text}, '([^\p{{L}}\p{{N}}_''])', '\1\1', 'g'), '{_pattern(ws)}', 1)"


_KEY = r"regexp_replace(lower({}), '[\s-]+', ' ', 'g')"
_BLANK = r"regexp_replace(regexp_replace(text, '([^\p{L}\p{N}_''])', '\1\1', 'g'), '(?i)(^|[^\p{L}\p{N}_''])of[\s-]+the($|[^\p{L}\p{N}_''])', '\1 \2', 'g')"


def _all_blanked(ws) -> str:
    return rf"regexp_extract_all({_BLANK}, '{_pattern(ws)}', 1)"


_T = f"""{_M}, l AS (SELECT *, max(t) OVER (PARTITION BY ep) AS len FROM m),
r AS (SELECT *, len({_all("text", ("the", "la"))}) AS said, CAST(CASE WHEN len > 0 THEN least(9, t * 10 // len) ELSE 0 END AS INTEGER) AS tenth, CAST(least(23, t // 300) AS INTEGER) AS slot FROM l),
h AS (SELECT * FROM r WHERE said > 0)"""
_TOK = f"""{_X}, k AS (
  SELECT ep, person, year, unnest(regexp_extract_all(regexp_replace(replace(lower(text), '’', ''''), '([a-z]) +''([a-z])', '\\1''\\2', 'g'), '[a-z]+(?:''[a-z]+)*')) AS word FROM x),
c AS (SELECT ep, person, year, word, count(*) AS n, least(count(*), 3) AS capped FROM k GROUP BY ALL)"""


def _sig(by: str, value: str, least: int, eps: int, lift: float, k: int) -> str:
    return f"""WITH {_TOK}, f AS (SELECT {by}, word, sum({value})::DOUBLE AS y, count(*) AS eps FROM c GROUP BY ALL), w AS (SELECT word, sum({value})::DOUBLE AS w FROM c GROUP BY word),
      g AS (SELECT {by}, sum(y) AS n_a FROM f GROUP BY {by}), a AS (SELECT sum(n_a) AS n_all FROM g),
      j AS (SELECT f.*, w, n_a, n_all, w - y AS y_b, n_all - n_a AS n_b, 1000.0::DOUBLE * w / n_all AS p FROM f JOIN w USING (word) JOIN g USING ({by}), a WHERE y >= {least} AND eps >= {eps} AND length(word) >= 3),
      z AS (SELECT {by}, word, round((ln((y + p) / (n_a + 1000 - y - p)) - ln((y_b + p) / (n_b + 1000 - y_b - p))) / sqrt(1 / (y + p) + 1 / (y_b + p)), 6) AS z, CAST(y AS BIGINT) AS n,
        round((y / n_a) / (greatest(y_b, 0.5) / n_b), 6) AS lift FROM j),
      q AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY z DESC, word) AS rank FROM z WHERE z > 0 AND lift >= {lift})
      SELECT {by}, word, z, n, lift, CAST(rank AS INTEGER) AS rank FROM q WHERE rank <= {k}"""


ORACLES = {
    "phrase_counts": f"""WITH {_M}, k AS (SELECT ep, CASE WHEN spk = '' THEN '?' ELSE spk END AS spk, unnest({_all("text", WORDS)}) AS w FROM m)
      SELECT ep, spk, {_KEY.format("w")} AS phrase, count(*) AS n FROM k GROUP BY ALL""",
    "phrase_counts_of_documents": f"""WITH {_X}, k AS (SELECT year, person AS spk, unnest({_all("text", WORDS)}) AS w FROM x)
      SELECT year, spk, {_KEY.format("w")} AS phrase, count(*) AS n FROM k GROUP BY ALL""",
    "hit_levels": "WITH " + _M + ", k AS (" + " UNION ALL ".join(f"SELECT *, '{name}' AS level, {_all_blanked(ws)} AS w FROM m" for name, ws in LEVELS.items()) + f""")
      SELECT ep, level, CAST(sum(len(w)) AS BIGINT) AS n, arg_min(t, row(t, id)) AS t, arg_min({_KEY.format("w[1]")}, row(t, id)) AS word, arg_min(spk, row(t, id)) AS who, arg_min(left(text, 220), row(t, id)) AS line
      FROM k WHERE len(w) > 0 GROUP BY ep, level""",
    "mentions_by_year": f"""WITH {_M}, k AS (SELECT series, year, CASE WHEN spk = 'user' THEN spk ELSE 'Others' END AS who, {_KEY.format("unnest(" + _all("text", [w for x in ITEMS.values() for w in x]) + ")")} AS w FROM m),
      i AS (SELECT *, CASE WHEN w IN ('the', 'la', 'der') THEN 'article' ELSE 'link' END AS item FROM k)
      SELECT item, series, year, who, CAST(grouping(who) AS TINYINT) AS level, count(*) AS n FROM i GROUP BY GROUPING SETS ((item, series, year), (item, series, year, who))""",
    "trend_rows": f"""WITH {_T} SELECT CAST(grouping(year, series, spk, tenth, slot, ep) AS BIGINT) AS grouping, year, series, spk, tenth, slot, ep, CAST(sum(said) AS BIGINT) AS said, count(*) AS lines, min(t) AS t_min, max(t) AS t_max
      FROM h GROUP BY GROUPING SETS ((year, series, spk), (series, tenth), (series, slot), (series, ep, spk))""",
    "trend_tenths": f"""WITH {_T}, q AS (SELECT series, i, CAST(coalesce(sum(said) FILTER (WHERE tenth = i), 0) AS BIGINT) AS n FROM h, range(10) b(i) GROUP BY ALL)
      SELECT series, string_agg(n, ',' ORDER BY i) AS counts FROM q GROUP BY series""",
    "trend_slots": f"""WITH {_T}, q AS (SELECT series, i, CAST(coalesce(sum(said) FILTER (WHERE slot = i), 0) AS BIGINT) AS n FROM h, range(24) b(i) GROUP BY ALL)
      SELECT series, string_agg(n, ',' ORDER BY i) AS counts FROM q GROUP BY series""",
    "trend_first_last": f"""WITH {_T} SELECT series, arg_min(ep, row(date, ep, t, id)) AS first_ep, arg_min(t, row(date, ep, t, id)) AS first_t, arg_max(ep, row(date, ep, t, id)) AS last_ep, arg_max(t, row(date, ep, t, id)) AS last_t FROM h GROUP BY series""",
    "trend_top_episodes": f"""WITH {_T}, q AS (SELECT series, ep, CAST(sum(said) AS BIGINT) AS said FROM h GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY said DESC, ep) AS rank FROM q)
      SELECT series, ep, said, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 10""",
    "speaker_counts": f"WITH {_M} SELECT spk, count(*) AS n FROM m WHERE spk <> '' GROUP BY spk HAVING count(*) >= 20 ORDER BY n DESC, spk LIMIT 40",
    "token_freq": f"WITH {_TOK} SELECT person, word, CAST(sum(n) AS BIGINT) AS n, CAST(sum(capped) AS BIGINT) AS capped, count(*) AS eps FROM c GROUP BY ALL",
    "log_odds_signature": _sig("person", "n", 10, 3, 1.5, 20),
    "vocab_ttr": f"""WITH {_X}, k AS (SELECT ep, person, regexp_extract_all(regexp_replace(replace(lower(text), '’', ''''), '([a-z]) +''([a-z])', '\\1''\\2', 'g'), '[a-z]+(?:''[a-z]+)*') AS w FROM x),
      u AS (SELECT person, ep, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM k), n AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY ep, i) - 1 AS rn, count(*) OVER (PARTITION BY person) AS words FROM u),
      b AS (SELECT person, rn // 1000 AS block, count(DISTINCT word) AS d, any_value(words) AS words FROM n WHERE words >= 10000 AND rn // 1000 < words // 1000 GROUP BY ALL)
      SELECT person, round(avg(d) / 1000, 6) AS ttr, any_value(words) AS words FROM b GROUP BY person""",
    "fragments": f"""WITH {_M}, k AS (SELECT ep, id, regexp_extract_all(regexp_replace(replace(lower(text), '’', ''''), '([a-z]) +''([a-z])', '\\1''\\2', 'g'), '[a-z]+(?:''[a-z]+)*') AS w FROM m),
      s AS (SELECT unnest(w) AS word, unnest(list_concat([NULL], w[:-2])) AS p, unnest(list_concat(w[2:], [NULL])) AS q FROM k), n AS (SELECT word FROM s GROUP BY word HAVING count(*) >= 3),
      u AS (SELECT word, count(*) AS uses, count(*) FILTER (WHERE p || word IN (FROM n) OR word || q IN (FROM n)) AS glued FROM s GROUP BY word)
      SELECT * FROM u WHERE glued > 0 AND glued >= uses / 3""",
    "all_words_search": f"WITH {_X} SELECT ep, person FROM x WHERE contains(lower(text), 'the') AND contains(lower(text), 'one') AND contains(lower(text), 'of')",
    "word_totals": rf"""WITH {_M} SELECT ep, id, CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT) AS words, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))) AS bare FROM m""",
}
