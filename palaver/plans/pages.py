"""Pages of figures: guests, rates, first hits, rankings, filters, lists, runs and phrases over sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import names
from palaver.functions import text as fx
from palaver.operators import flow, pages, style, topics, words
from palaver.session import kept
from palaver.plans.bindings import LINES_SQL, PERSON_SQL, TALK_SQL, lines, table, talk_rows
from palaver.plans.misc import _F, TOPICS
from palaver.plans.words import _M, _TOK, LEVELS, WORDS, messages, texts
from palaver.plans.words import ORACLES as WORD_SQL

#: Where a word begins and ends, for an expression language without Unicode word bounds.
_B, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
ORDER = ("strict", "wide", "loose")
YEAR_SKIP = ("the", "and")


def sentences(s: SparkSession, d: str) -> DataFrame:
    """Documents as episodes, their sentences as lines of three seconds; how long a line is says who speaks."""
    x = table(s, d, "documents").select(F.col("doc_id").alias("ep"), F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")).alias("id", "text"))
    n = F.length("text") % 4
    return x.select("ep", F.col("id").cast("long").alias("id"), (F.col("id") * 3).cast("long").alias("t"), F.when(n == 0, "").when(n == 1, "ann").otherwise("bob").alias("spk"), "text")


_S = """s AS (
  SELECT ep, id, id * 3 AS t, CASE length(text) % 4 WHEN 0 THEN '' WHEN 1 THEN 'ann' ELSE 'bob' END AS spk, text
  FROM (SELECT doc_id AS ep, unnest(p) AS text, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS id FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), '. ') AS p FROM documents)))"""


def named_parts(s: SparkSession, d: str) -> DataFrame:
    """Episode names in the spellings that occur: with #, a dash, a dot, an ordinal, a fraction, no number, no date."""
    p = table(s, d, "part")
    n, size = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    lead = F.when(n == 0, F.concat(F.lit("#"), size, F.lit(" "))).when(n == 1, F.concat(F.lit("- "), size, F.lit(". "))).when(n == 2, F.concat(F.lit("- "), size, F.lit(" "))).when(n == 3, F.concat(size, F.lit("th "))).when(n == 4, F.concat(size, F.lit(".5 "))).otherwise("")
    day = F.when(n == 6, "").otherwise(F.concat(F.lit("20"), F.lpad((F.col("p_partkey") % 30).cast("string"), 2, "0"), F.lit("-0"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit("-17 ")))
    return p.select(F.col("p_partkey").alias("id"), F.concat(day, lead, "p_name").alias("name"))


_P = r"""p AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 6 THEN '' ELSE '20' || lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0') || '-0' || CAST(p_partkey % 9 + 1 AS VARCHAR) || '-17 ' END
    || CASE p_partkey % 7 WHEN 0 THEN '#' || p_size || ' ' WHEN 1 THEN '- ' || p_size || '. ' WHEN 2 THEN '- ' || p_size || ' ' WHEN 3 THEN p_size || 'th ' WHEN 4 THEN p_size || '.5 ' ELSE '' END || p_name AS name FROM part),
n AS (
  SELECT id, name, CASE WHEN id % 7 = 6 THEN '' ELSE left(name, 10) END AS date,
    CASE WHEN id % 7 IN (0, 1, 2) THEN regexp_extract(substr(name, 11), '\d+') WHEN id % 7 = 4 THEN regexp_extract(substr(name, 11), '\d+\.5') ELSE '' END AS number,
    CASE WHEN id % 7 = 3 THEN regexp_extract(name, '\d+th .*') ELSE regexp_extract(name, '[a-z].*$') END AS title FROM p)"""


def _forms(s, d):
    n = F.col("name")
    return named_parts(s, d).select("id", names.number(n).alias("number"), names.title(n).alias("title"), names.label(n).alias("label"), names.period(names.date(n), F.col("id"), "month").alias("month"), F.round(names.year_fraction(names.date(n)), 6).alias("years"))


def _chosen(s, d):
    n = named_parts(s, d).withColumns({"kind": names.kind(F.col("name"), (("(?i)^#?[0-9.]* ?[a-z]*red", "Warm"), ("(?i)\\bblue\\b", "Cold"))), "title": names.title(F.col("name")), "date": names.date(F.col("name"))})
    n = n.where((F.col("kind") != "Warm") & ~F.col("title").rlike("(?i)small") & F.contains(F.lower("title"), F.lit("e")) & F.startswith("date", F.lit("201")))
    return n.select("id", "kind", pages.episode_group(F.col("kind")).alias("grp"))


def _said(s, d):
    return words.phrase_counts(messages(s, d), WORDS, ("ep", "spk"))


def _facts(s, d):
    return messages(s, d).where("spk != ''").select("ep", "id", "t", F.col("spk").alias("who"), topics.topic(F.col("text"), TOPICS).alias("topic"))


def _modes(s, d):
    return pages.cumulative_hits(words.hit_levels(messages(s, d), LEVELS, ("of the",)), ORDER)


def _years(s, d):
    x = table(s, d, "documents").select(F.col("doc_id").alias("ep"), F.col("lang").alias("person"), (2018 + F.col("doc_id") % 5).cast("string").alias("year"), "text")
    return style.year_words(style.token_counts(x), YEAR_SKIP, ("en",), least=6, episodes=3, share=0.02, lift=1.2, year_least=5, k=5)


def _trimmed(s, d):
    y = kept(_years(s, d))
    return style.trimmed(y.withColumn("grp", F.concat("person", "year")), "grp", y.where(F.col("word").rlike("^[a-m]")), 5).drop("grp")


def _sized(s, d):
    x = sentences(s, d)
    return x.withColumn("sec", F.lit(3.0))


QUERIES = {
    "name_forms": _forms,
    "chosen_episodes": _chosen,
    "guest_page": lambda s, d: pages.guest_page(talk_rows(s, d), ("view",), {"click": "Clicker", "purchase": "Buyer"}, F.col("series") == "even", 30),
    "swear_rates": lambda s, d: pages.rates(_said(s, d).join(messages(s, d).select("ep", "year").distinct(), "ep"), messages(s, d).where("spk != ''").withColumn("sec", F.lit(7)), ("spk", "year")),
    "swear_favourites": lambda s, d: pages.favourites(_said(s, d), k=3),
    "swear_top_word": lambda s, d: pages.top_of_each(_said(s, d)),
    "mode_first_hits": _modes,
    "mode_summary": lambda s, d: pages.hit_summary(_modes(s, d).join(messages(s, d).select("ep", "year").distinct(), "ep"), ("user",)),
    "item_ranking": lambda s, d: pages.ranked_with_rest(words.phrase_counts(texts(s, d).withColumn("spk", F.col("person")), WORDS, ("year", "spk")), "phrase", "spk", 2),
    "fact_filters": lambda s, d: pages.filter_counts(_facts(s, d), ("user",), "topic"),
    "facts_of_people": lambda s, d: _facts(s, d).where(pages.among(F.col("who"), ("Guests",), ("user",)) & (F.col("topic") != "Other")).select("ep", "id", "who"),
    "trademark_word": lambda s, d: pages.trademark(style.signatures(style.token_counts(texts(s, d)), least=10, episodes=3)),
    "table_descending": lambda s, d: pages.page(pages.sorted_rows(named_parts(s, d).select("id", F.nullif(names.number(F.col("name")), F.lit("")).try_cast("double").alias("number")), "number", True, ("id",)), 1, 20, 50),
    "table_ascending": lambda s, d: pages.page(pages.sorted_rows(named_parts(s, d).select("id", F.nullif(names.number(F.col("name")), F.lit("")).try_cast("double").alias("number")), "number", False, ("id",)), 0, 40),
    "names_from_a_to_z": lambda s, d: pages.page(pages.alphabetical(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "name", ("id",)), 2, 10, 30),
    "one_fact_at_random": lambda s, d: pages.one_at_random(_facts(s, d), ("ep", "who"), "id", "today"),
    "phrases_across_lines": lambda s, d: pages.phrases_across_lines(sentences(s, d), r"(?U)\b[dD]e[\s-]+la\b", "[dD]e"),
    "second_voice_pieces": lambda s, d: flow.pieces(_sized(s, d), "in", 6.0),
    "sentence_turns": lambda s, d: flow.turns(sentences(s, d)).groupBy("ep", "turn").agg(F.first("spk").alias("spk"), F.min("t").alias("t"), F.count(F.lit(1)).alias("lines")),
    "year_words": _years,
    "word_of_year": lambda s, d: _years(s, d).where("rank = 1").select("person", "year", "word", "z"),
    "year_words_trimmed": _trimmed,
    "multiset_difference": lambda s, d: style.fewer(*[style.token_counts(texts(s, d)).where(F.col("year") == y).groupBy("word").agg(F.sum("n").alias("n")) for y in ("2018", "2019")]),
    "multiset_sum": lambda s, d: style.combined(*[style.token_counts(texts(s, d)).where(F.col("year") == y).groupBy("word").agg(F.sum("n").alias("n")) for y in ("2018", "2019")]),
    "highlighted": lambda s, d: messages(s, d).select("ep", "id", F.md5(fx.highlight(F.regexp_replace("text", "[^a-zA-Z ]", "."), ("the", "la"))).alias("text")),
    "clock_times": lambda s, d: lines(s, d).select("id", fx.clock(F.col("t")).alias("clock")),
}

_L = f"h AS ({WORD_SQL['hit_levels']})"
_PC = f"pc AS ({WORD_SQL['phrase_counts']})"
_Y = f"""WITH {_TOK.replace("source AS person", "lang AS person")}, f AS (SELECT person, year, word, CAST(sum(n) AS BIGINT) AS n, CAST(sum(capped) AS BIGINT) AS cap, count(*) AS eps FROM c GROUP BY ALL),
  w AS (SELECT word, sum(cap)::DOUBLE AS prior FROM f GROUP BY word), v AS (SELECT person, word, sum(cap)::DOUBLE AS whole, sum(eps) AS whole_eps FROM f GROUP BY ALL),
  y AS (SELECT person, year, count(DISTINCT ep) AS n_eps, sum(capped)::DOUBLE AS n_a FROM c GROUP BY ALL), a AS (SELECT person, sum(n_eps) AS all_eps, sum(n_a) AS n_all FROM y GROUP BY person), t AS (SELECT sum(n_all) AS n_prior FROM a),
  j AS (SELECT f.*, n_eps, n_a, whole - cap AS y_b, n_all - n_a AS n_b, 1000.0::DOUBLE * prior / n_prior AS p FROM f JOIN y USING (person, year) JOIN a USING (person) JOIN v USING (person, word) JOIN w USING (word), t
    WHERE n_eps >= 5 AND n >= 6 AND length(word) >= 3 AND word NOT IN ('the', 'and', 'en') AND eps >= greatest(3, ceil(0.02::DOUBLE * n_eps))
      AND eps::DOUBLE / n_eps >= 1.2::DOUBLE * ((whole_eps - eps + 1)::DOUBLE / greatest(all_eps - n_eps, 1)) AND eps < 0.75::DOUBLE * n_eps AND NOT (n < 1.25::DOUBLE * eps AND eps >= greatest(10.0::DOUBLE, n_eps / 4.0::DOUBLE))),
  z AS (SELECT person, year, word, round((ln((cap + p) / (n_a + 1000 - cap - p)) - ln((y_b + p) / (n_b + 1000 - y_b - p))) / sqrt(1 / (cap + p) + 1 / (y_b + p)), 6) AS z, n, eps FROM j),
  q AS (SELECT *, CAST(row_number() OVER (PARTITION BY person, year ORDER BY z DESC, word) AS INTEGER) AS rank FROM z WHERE z > 0)"""
_C2 = ", ".join(f"y{y} AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE year = '{y}' GROUP BY word)" for y in (2018, 2019))
_NUM = f"WITH {_P} SELECT id, TRY_CAST(nullif(number, '') AS DOUBLE) AS number FROM n"
ORACLES = {
    "name_forms": f"""WITH {_P} SELECT id, number, title, CASE WHEN number <> '' THEN '#' || number || ' ' || title ELSE title END AS label, left(date, 7) AS month,
      CASE WHEN date <> '' THEN round(CAST(left(date, 4) AS INTEGER) + (CAST(substr(date, 6, 2) AS INTEGER) - 1) / 12.0::DOUBLE + 16 / 365.0::DOUBLE, 6) END AS years FROM n""",
    "chosen_episodes": rf"""WITH {_P}, k AS (SELECT *, CASE WHEN regexp_matches(ltrim(regexp_replace(name, '^\d{{4}}-\d\d-\d\d\s*-?\s*', '')), '(?i)^#?[0-9.]* ?[a-z]*red') THEN 'Warm' WHEN regexp_matches(name, '(?i)\bblue\b') THEN 'Cold' ELSE 'Main' END AS kind FROM n)
      SELECT id, kind, CASE WHEN kind = 'Main' THEN 'm' ELSE 'o' END AS grp FROM k WHERE kind <> 'Warm' AND NOT contains(lower(title), 'small') AND contains(lower(title), 'e') AND starts_with(date, '201')""",
    "guest_page": f"""WITH {TALK_SQL}, gp AS (SELECT CASE spk WHEN 'click' THEN 'Clicker' WHEN 'purchase' THEN 'Buyer' ELSE spk END AS name, sec, date FROM talk WHERE series = 'even' AND sec >= 30),
      a AS (SELECT name, count(*) AS count, CAST(sum(sec) AS BIGINT) AS talk, min(date) AS first, max(date) AS last, count(*) > 1 AS again FROM gp WHERE name <> 'view' GROUP BY name)
      SELECT *, CAST(row_number() OVER (ORDER BY count DESC, talk DESC, name) AS INTEGER) AS rank FROM a ORDER BY rank LIMIT 15""",
    "swear_rates": f"""WITH {_PC}, {_M}, e AS (SELECT DISTINCT ep, year FROM m), n AS (SELECT spk, year, CAST(sum(n) AS BIGINT) AS n FROM pc JOIN e USING (ep) GROUP BY ALL), s AS (SELECT spk, year, CAST(7 * count(*) AS BIGINT) AS sec FROM m WHERE spk <> '' GROUP BY ALL)
      SELECT spk, year, coalesce(n, 0) AS n, sec, round(3600 * coalesce(n, 0) / sec, 6) AS rate FROM s LEFT JOIN n USING (spk, year)""",
    "swear_favourites": f"WITH {_PC} SELECT phrase, CAST(sum(n) AS BIGINT) AS n FROM pc GROUP BY phrase ORDER BY n DESC, phrase LIMIT 3",
    "swear_top_word": f"WITH {_PC}, g AS (SELECT ep, phrase, CAST(sum(n) AS BIGINT) AS n FROM pc GROUP BY ALL) SELECT ep, CAST(sum(n) AS BIGINT) AS n, first(phrase ORDER BY n DESC, phrase) AS top FROM g GROUP BY ep",
    "mode_first_hits": f"""WITH {_L}, r AS (SELECT *, list_position(['strict', 'wide', 'loose'], level) AS k FROM h), m AS (SELECT unnest(['strict', 'wide', 'loose']) AS mode, unnest([1, 2, 3]) AS j)
      SELECT ep, mode, CAST(sum(n) AS BIGINT) AS n, first(t ORDER BY t, k) AS t, first(who ORDER BY t, k) AS who FROM r JOIN m ON k <= j GROUP BY ep, mode""",
    "mode_summary": f"""WITH {_L}, {_M}, r AS (SELECT *, list_position(['strict', 'wide', 'loose'], level) AS k FROM h), o AS (SELECT unnest(['strict', 'wide', 'loose']) AS mode, unnest([1, 2, 3]) AS j),
      f AS (SELECT ep, mode, first(t ORDER BY t, k) AS t, first(who ORDER BY t, k) AS who FROM r JOIN o ON k <= j GROUP BY ep, mode), g AS (SELECT mode, year, CASE WHEN who = 'user' THEN who ELSE 'Guest' END AS who, t FROM f JOIN (SELECT DISTINCT ep, year FROM m) USING (ep))
      SELECT mode, year, who, count(*) AS episodes, round(median(t), 6) AS median, min(t) AS fastest, max(t) AS slowest FROM g GROUP BY GROUPING SETS ((mode, year), (mode, who))""",
    "item_ranking": f"""WITH pc AS ({WORD_SQL["phrase_counts_of_documents"]}), c AS (SELECT phrase, spk, CAST(sum(n) AS BIGINT) AS n FROM pc GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY n DESC, spk) AS k FROM c)
      SELECT phrase, CAST(least(k, 3) AS INTEGER) AS rank, CASE WHEN k <= 2 THEN spk ELSE 'others' END AS who, CAST(sum(n) AS BIGINT) AS n, count(*) AS people FROM r GROUP BY ALL""",
    "fact_filters": f"""WITH {_F} SELECT 'person' AS filter, CASE WHEN who = 'user' THEN who ELSE 'Guests' END AS value, count(*) AS n FROM f WHERE who <> '' GROUP BY ALL
      UNION ALL SELECT 'section', topic, count(*) FROM f GROUP BY topic HAVING count(*) >= 5""",
    "facts_of_people": f"WITH {_F} SELECT ep, id, who FROM f WHERE who NOT IN ('', 'user') AND topic <> 'Other'",
    "trademark_word": f"WITH s AS ({WORD_SQL['log_odds_signature']}) SELECT t.person, t.word, t.lift FROM (SELECT arg_max(s, row(lift, person, word)) AS t FROM s WHERE rank <= 10)",
    "table_descending": f"{_NUM} ORDER BY number DESC NULLS FIRST, id LIMIT 50 OFFSET 20",
    "table_ascending": f"{_NUM} ORDER BY number ASC NULLS LAST, id LIMIT 40",
    "names_from_a_to_z": "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 30 OFFSET 40",
    "one_fact_at_random": f"WITH {_F} SELECT ep, who, first(id ORDER BY md5('today' || CAST(id AS VARCHAR)), id) AS id FROM f GROUP BY ep, who",
    "phrases_across_lines": rf"""WITH {_S}, j AS (SELECT *, coalesce(lead(text) OVER (PARTITION BY ep ORDER BY t, id), '') AS nxt FROM s)
      SELECT ep, id, 'de la' AS phrase, NOT regexp_matches(text, '{_B}[dD]e[\s-]+la{_E}') AS spans FROM j WHERE regexp_matches(text, '{_B}[dD]e[\s-]+la{_E}') OR (regexp_matches(text, '{_B}[dD]e[\s-]*$') AND regexp_matches(nxt, '^[\s-]*la{_E}'))""",
    "second_voice_pieces": f"""WITH {_S}, u AS (SELECT *, contains(text, 'in') AS cut, CASE WHEN row_number() OVER w > 1 AND lag(spk) OVER w = spk THEN 0 ELSE 1 END AS st FROM s WINDOW w AS (PARTITION BY ep ORDER BY t, id)),
      v AS (SELECT *, CAST(sum(st) OVER (PARTITION BY ep ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM u), x AS (SELECT *, CAST(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY ep, turn ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS piece FROM v)
      SELECT ep, turn, piece, any_value(spk) AS spk, min(t) AS begins, 3.0::DOUBLE * count(*) AS sec, count(*) AS lines FROM x WHERE NOT cut AND {PERSON_SQL} GROUP BY ep, turn, piece HAVING count(*) >= 2""",
    "sentence_turns": f"""WITH {_S}, u AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(spk) OVER w = spk THEN 0 ELSE 1 END AS st FROM s WINDOW w AS (PARTITION BY ep ORDER BY t, id)),
      v AS (SELECT *, CAST(sum(st) OVER (PARTITION BY ep ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM u) SELECT ep, turn, any_value(spk) AS spk, min(t) AS t, count(*) AS lines FROM v GROUP BY ep, turn""",
    "word_of_year": f"{_Y} SELECT person, year, word, z FROM q WHERE rank = 1",
    "year_words": f"{_Y} SELECT person, year, word, z, n, eps, rank FROM q WHERE rank <= 10",
    "year_words_trimmed": f"{_Y}, ky AS (SELECT * FROM q WHERE rank <= 10), r AS (SELECT *, row_number() OVER (PARTITION BY person, year ORDER BY rank) AS n2 FROM ky WHERE word NOT IN (SELECT word FROM ky WHERE regexp_matches(word, '^[a-m]'))) SELECT person, year, word, z, n, eps, CAST(n2 AS INTEGER) AS rank FROM r WHERE n2 <= 5",
    "multiset_difference": f"WITH {_TOK}, {_C2} SELECT word, y2018.n - coalesce(y2019.n, 0) AS n FROM y2018 LEFT JOIN y2019 USING (word) WHERE y2018.n > coalesce(y2019.n, 0)",
    "multiset_sum": f"WITH {_TOK}, {_C2} SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM y2018 UNION ALL SELECT * FROM y2019) GROUP BY word",
    "highlighted": rf"""WITH {_M} SELECT ep, id, md5(regexp_replace(regexp_replace(text, '[^a-zA-Z ]', '.', 'g'), '(?i)\b(the|la)\b', '<mark>\1</mark>', 'g')) AS text FROM m""",
    "clock_times": f"""WITH {LINES_SQL} SELECT id, CASE WHEN t < 3600 THEN CAST(t // 60 AS VARCHAR) || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') ELSE CAST(t // 3600 AS VARCHAR) || ':' || lpad(CAST(t // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') END AS clock FROM lines""",
}
