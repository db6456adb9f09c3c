"""Inputs and their stamps, guests by description, corrections, declarations, and names that begin with others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions.text import count_words
from palaver.operators import corrections, declared, guests, index, prefixes, style, talk, words
from palaver.plans.bindings import DURATIONS_SQL, LINES_SQL, table
from palaver.plans.pages import _S
from palaver.plans.talk import ORACLES as TALK_SQL_OF
from palaver.plans.words import _M, messages, texts
from palaver.plans.words import ORACLES as WORD_SQL


def _inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A customer's orders as an input whose stamp is the newest one's: all but urgent ones now, finished ones when last seen."""
    o = table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("ep"), F.unix_timestamp("o_orderdate").cast("double").alias("stamp"), "o_orderstatus", "o_orderpriority")
    of = lambda where: o.where(where).groupBy("ep").agg(F.max("stamp").alias("stamp"))
    return of("o_orderpriority != '1-URGENT'"), of("o_orderstatus = 'F'")


PEOPLE = guests.People({"Then": ("then and",), "Und": ("und den",)}, ("The", "And", "Of"), {}, ("Reation", "Orre"))


def _described(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A document as an episode: its first capitalised words are the people of a description, its text is what is said."""
    x = table(s, d, "documents").select(F.col("doc_id").alias("ep"), F.col("text"), F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0)).alias("c")).where("size(c) >= 6")
    c = [F.col("c")[i] for i in range(6)]
    told = F.concat(c[0], F.lit(", "), c[1], F.lit(" "), c[2], F.lit(" and special guest "), c[3], F.lit(" "), c[4], F.lit(" of it are discussing. We are joined by walker "), c[5], F.lit(" "), c[0], F.lit(" MBE! "), c[2], F.lit(" "), c[5], F.lit(" joins The rest."))
    return x.select("ep", F.concat_ws(" ", c[1], c[2]).alias("title"), told.alias("description")), x.select("ep", "text")


RULES = (
    corrections.possessed("name", "Than Wow|Ther", "There"),
    corrections.spelled("article", "der|die", "das", True),
    corrections.behind("behind", "of ", "the", "a"),
)
PHRASE, HINT = r"(?iuU)\b(?:the|die|la)\s+\p{L}+\b", "(?i)the|die|la"


def _corrected(s, d):
    m = messages(s, d)
    return m.select("ep", "id", corrections.corrected(F.col("text"), RULES[1:]).alias("c")).select("ep", "id", "c.n", F.md5("c.text").alias("text"))


def _declared(s, d) -> DataFrame:
    """Every second word behind an article, declared by what it begins with; some reads fit nothing any more."""
    m = messages(s, d)
    found = declared.mentions(m, PHRASE, HINT)
    last = F.element_at(F.split("phrase", " "), -1)
    verdict = F.when(last.rlike("^[a-e]"), "friend").when(last.rlike("^[f-o]"), "enemy").when(last.rlike("^[p-s]"), "unclear").otherwise("maybe")
    who = F.array(F.substring(last, 1, 2), F.col("spk"))
    one = Window.partitionBy("ep", "phrase").orderBy("t", "id")
    reads = found.withColumn("k", F.row_number().over(one)).where("k = 1 and spk != ''").select("ep", "phrase", F.when(F.length("quote") > 250, F.col("t") + 5000).otherwise(F.col("t") + 2).alias("t"), verdict.alias("verdict"), who.alias("who"), F.substring("quote", 1, 9).alias("why"))
    return declared.judged(found, reads, m)


def _names(s, d) -> DataFrame:
    p, c = table(s, d, "part"), table(s, d, "customer")
    whole = p.select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"))
    return whole.unionByName(p.where("p_size > 25").select(F.col("p_name").alias("name"))).unionByName(c.where("c_acctbal < 0").select(F.concat_ws(" - ", "c_name", "c_mktsegment").alias("name"))).unionByName(p.where("p_retailprice > 1500").select(F.concat_ws(" ", "p_name", "p_brand").alias("name")))


def _judged(s, d):
    j = _declared(s, d)
    return j.select("n", "ep", "t", "phrase", F.md5("quote").alias("quote"), "verdict", F.array_join("who", "|").alias("who"), "why", F.size("near").alias("near"))


def _people(s, d):
    join = lambda c: F.array_join(c, ",").alias(c)
    return declared.people(_declared(s, d)).select("name", join("friend"), join("enemy"), join("acquaintance"), "both", "why")


SHOW = "en"


def talked(s: SparkSession, d: str) -> DataFrame:
    """Sentences as lines of shows (languages), with what durations need; how long a line is says who speaks, how long a document is what kind it is and when it was."""
    who = F.element_at(F.array(*map(F.lit, ("", "ann", "bob", "cy", "dee", "guest 2", "ann"))), F.length("text") % 7 + 1)
    date = F.concat((2018 + F.col("n_chars") % 5).cast("string"), F.lit("-0"), (1 + F.col("n_chars") % 9).cast("string"), F.lit("-01"))
    x = table(s, d, "documents").select(
        F.col("doc_id").alias("ep"), F.col("lang").alias("series"), date.alias("date"), F.when(F.col("n_chars") > 1000, "Main").otherwise("Special").alias("kind"), F.col("source").alias("title"),
        F.posexplode(F.split(F.translate("text", "\n", " "), r"\. ")).alias("id", "text"),
    )
    return x.withColumns({"id": F.col("id").cast("long"), "t": (F.col("id") * 3).cast("long"), "spk": who, "words": count_words(F.col("text")), "chars": F.length("text")})


def _headlines(s, d):
    x = talked(s, d)
    facts = x.where(F.col("text").rlike("^(?:The|La|Die) ")).select(F.col("spk").alias("who"))
    judged = table(s, d, "labels").select((F.col("quality") == 1).alias("friend"), (F.col("toxic") == 1).alias("enemy"))
    h = talk.headlines(x, ("ann", "bob"), SHOW, ("the",), ("la", "der"), ("of", "de", "in", "et"), ("and", "und", "que"), facts, judged, style.vocabulary(texts(s, d)), hours=0.1, run={"start": 3, "end": 3, "least": 3.0})
    told = lambda c, name, value, by=1: F.array_join(F.transform(c, lambda x: F.concat(name(x), F.lit("="), F.round(x[value] * by).cast("long").cast("string"))), ",")
    f = F.col("ttp.fastest")
    return h.select(
        F.col("ttp.with").alias("ttp_with"), F.col("ttp.of").alias("ttp_of"), F.col("ttp.median").alias("ttp_median"), F.concat_ws("|", f["t"].cast("string"), f["date"], f["ep"].cast("string"), f["who"]).alias("ttp_fastest"),
        told("talk", lambda x: x["spk"], "percent", 10).alias("talk"), told("guests", lambda x: x["spk"], "n").alias("guests"), told("swears", lambda x: x["spk"], "rate", 10).alias("swears"), told("phrases", lambda x: x["phrase"], "n").alias("phrases"),
        F.col("facts.total").alias("facts"), told("facts.top", lambda x: x["who"], "n").alias("facts_top"), F.col("lineup.all").alias("lineup_all"), F.col("lineup.of").alias("lineup_of"), "episodes", "hours",
        told("hours_by_year", lambda x: F.concat(x["series"], x["year"]), "hours", 100).alias("hours_by_year"), F.array_join("hosts", ",").alias("hosts"), F.concat("flow.spk", F.lit("="), F.round("flow.sec").cast("long").cast("string")).alias("flow"),
        F.concat("style.person", F.lit("="), F.round(F.col("style.ttr") * 1000).cast("long").cast("string")).alias("style"), told("mentions", lambda x: x["series"], "rate", 10).alias("mentions"), F.col("pod.friends").alias("friends"), F.col("pod.enemies").alias("enemies"),
    )


QUERIES = {
    "headlines": _headlines,
    "trend_of_sentences": lambda s, d: words.trend(words.matched(talked(s, d).withColumn("year", F.substring("date", 1, 4)), ("the",))),
    "input_decisions": lambda s, d: index.decisions(*_inputs(s, d)),
    "guest_candidates": lambda s, d: guests.candidates(*_described(s, d), PEOPLE).select("ep", "name", "score"),
    "corrected_lines": _corrected,
    "declarations": _judged,
    "declared_people": _people,
    "stale_reads": lambda s, d: declared.stale(_declared(s, d)),
    "name_owners": lambda s, d: prefixes.owners(_names(s, d)),
}
_NAME = r"(?:(?:Dr\.|Dr|Professor|Sir|Dame) )?[A-Z][a-z''’\-]+(?: (?:[A-Z][a-zA-Z''’\-]+|de|van|von|al|el)){1,2}"
_D = rf"""{_M}, j AS (SELECT *, text || ' ' || coalesce(lead(text) OVER (PARTITION BY ep ORDER BY t, id), '') AS two, coalesce(lead(text) OVER (PARTITION BY ep ORDER BY t, id), '') AS nxt FROM m),
k AS (SELECT ep, date, id, t, spk, text, nxt, unnest(regexp_extract_all(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])((?:the|die|la)\s+\p{{L}}+)', 1)) AS p FROM j),
f AS (SELECT ep, date, id, t, spk, lower(regexp_replace(p, '[\s-]+', ' ', 'g')) AS phrase, left(text, 260) AS quote FROM k GROUP BY ALL),
n AS (SELECT *, row_number() OVER (ORDER BY date, ep, t, id, phrase) - 1 AS n, row_number() OVER (PARTITION BY ep, phrase ORDER BY t, id) AS k FROM f),
v AS (SELECT *, string_split(phrase, ' ')[2] AS w, k = 1 AND spk <> '' AS is_read, length(quote) > 250 AS far FROM n),
r AS (SELECT *, CASE WHEN regexp_matches(w, '^[a-e]') THEN 'friend' WHEN regexp_matches(w, '^[f-o]') THEN 'enemy' WHEN regexp_matches(w, '^[p-s]') THEN 'unclear' ELSE 'unread' END AS vd FROM v)"""
_COUNT = lambda ws: "CAST(len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_'']+'), lambda x: lower(x) IN (" + ", ".join(f"'{w}'" for w in ws) + "))) AS BIGINT)"
_TALKED = f"""{_S},
lines AS (
  SELECT s.ep, s.id, s.t, ['', 'ann', 'bob', 'cy', 'dee', 'guest 2', 'ann'][length(s.text) % 7 + 1] AS spk, s.text, CAST(len(regexp_extract_all(s.text, '[^\\s]+')) AS BIGINT) AS words, CAST(length(s.text) AS BIGINT) AS chars, lang AS series,
    CAST(2018 + n_chars % 5 AS VARCHAR) || '-0' || CAST(1 + n_chars % 9 AS VARCHAR) || '-01' AS date, CASE WHEN n_chars > 1000 THEN 'Main' ELSE 'Special' END AS kind, source AS title FROM s JOIN documents ON doc_id = s.ep)"""
_PERSON = "(spk NOT IN ('', 'guest 2'))"
_RUNS = TALK_SQL_OF["longest_runs"].replace(LINES_SQL, f"""{_TALKED.replace("lines AS", "every AS")}, lines AS (SELECT * FROM every WHERE series = '{SHOW}' AND kind = 'Main')""").replace(">= 8 ", ">= 3 ").replace("begins >= 10", "begins >= 3").replace("last - 6", "last - 3")
ORACLES = {
    "trend_of_sentences": f"""WITH {_TALKED}, k AS (SELECT *, {_COUNT(["the"])} AS said, max(t) OVER (PARTITION BY ep) AS len, left(date, 4) AS year FROM lines),
      r AS (SELECT *, CASE WHEN len > 0 THEN least(9, CAST(floor(t * 10 / len) AS INTEGER)) ELSE 0 END AS tenth, least(23, CAST(floor(t / 300) AS INTEGER)) AS slot FROM k WHERE said > 0)
      SELECT CAST(grouping(year, series, spk, tenth, slot, ep) AS BIGINT) AS grouping, year, series, spk, tenth, slot, ep, CAST(sum(said) AS BIGINT) AS said, count(*) AS lines, min(t) AS t_min, max(t) AS t_max
      FROM r GROUP BY GROUPING SETS ((year, series, spk), (series, tenth), (series, slot), (series, ep, spk))""",
    "headlines": f"""WITH {_TALKED}{DURATIONS_SQL.removeprefix(LINES_SQL)},
x AS (SELECT *, {_COUNT(["the"])} AS st, {_COUNT(["la", "der"])} AS sw, {_COUNT(["and", "und", "que"])} AS it, {_COUNT(["of"])} AS p1, {_COUNT(["de"])} AS p2, {_COUNT(["in"])} AS p3, {_COUNT(["et"])} AS p4 FROM dur),
e AS (SELECT ep, any_value(series) AS series, any_value(date) AS date, any_value(kind) AS kind, CAST(round(round(arg_max(t + dur, row(t, id)), 6)) AS BIGINT) AS len, min(row(t, id, spk)) FILTER (WHERE st > 0) AS hit, sum(it) AS it FROM x GROUP BY ep),
p AS (SELECT ep, any_value(series) AS series, any_value(kind) AS kind, spk, sum(dur) AS raw, sum(sw) AS sw FROM x GROUP BY ep, spk),
y AS (SELECT *, CAST(round(round(raw, 6)) AS BIGINT) AS sec FROM p WHERE {_PERSON} AND round(raw, 6) >= 30),
ours AS (SELECT * FROM y WHERE series = '{SHOW}' AND kind = 'Main'),
hit AS (SELECT *, hit[1] AS ht FROM e WHERE kind = 'Main' AND series = '{SHOW}'),
tk AS (SELECT spk, round(100 * avg(share), 1) AS v FROM (SELECT *, sec / greatest(sum(sec) OVER (PARTITION BY ep), 1) AS share FROM ours WHERE spk IN ('ann', 'bob')) GROUP BY spk),
gs AS (SELECT spk, count(*) AS n, sum(sec) AS s FROM y WHERE spk NOT IN ('ann', 'bob') AND sec >= 60 GROUP BY spk),
sr AS (SELECT a.spk, round(3600 * a.n / b.s, 1) AS v FROM (SELECT spk, sum(sw) AS n FROM p GROUP BY spk) a JOIN (SELECT spk, sum(sec) AS s FROM y GROUP BY spk) b ON a.spk = b.spk WHERE a.n > 0 AND b.s > 360),
ph AS (SELECT phrase, n FROM (SELECT unnest(['of', 'de', 'in', 'et']) AS phrase, unnest([CAST(sum(p1) AS BIGINT), CAST(sum(p2) AS BIGINT), CAST(sum(p3) AS BIGINT), CAST(sum(p4) AS BIGINT)]) AS n FROM x) WHERE n > 0),
fa AS (SELECT spk AS who FROM lines WHERE regexp_matches(text, '^(?:The|La|Die) ')), fw AS (SELECT who, count(*) AS n FROM fa WHERE who <> '' GROUP BY who),
li AS (SELECT ep, count(*) FILTER (WHERE spk IN ('ann', 'bob') AND sec >= 120) AS n FROM ours GROUP BY ep),
hy AS (SELECT series, left(date, 4) AS year, round(sum(len) / 3600, 2) AS v FROM e GROUP BY ALL), me AS (SELECT series, round(sum(it) / nullif(sum(len) / 3600, 0), 1) AS v FROM e GROUP BY series),
ru AS ({_RUNS}), vo AS ({WORD_SQL["vocab_ttr"]})
SELECT (SELECT count(hit) FROM hit) AS ttp_with, (SELECT count(*) FROM hit) AS ttp_of, (SELECT median(ht)::DOUBLE FROM hit) AS ttp_median,
  (SELECT CAST(m[1] AS VARCHAR) || '|' || m[2] || '|' || CAST(m[3] AS VARCHAR) || CASE WHEN m[4] IS NULL THEN '' ELSE '|' || m[4] END FROM (SELECT min(row(ht, date, ep, hit[3])) AS m FROM hit WHERE hit IS NOT NULL)) AS ttp_fastest,
  (SELECT string_agg(spk || '=' || CAST(CAST(round(v * 10) AS BIGINT) AS VARCHAR), ',' ORDER BY v DESC, spk) FROM tk) AS talk,
  coalesce((SELECT string_agg(spk || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, s DESC, spk) FROM (SELECT * FROM gs ORDER BY n DESC, s DESC, spk LIMIT 3)), '') AS guests,
  coalesce((SELECT string_agg(spk || '=' || CAST(CAST(round(v * 10) AS BIGINT) AS VARCHAR), ',' ORDER BY v DESC, spk) FROM (SELECT * FROM sr ORDER BY v DESC, spk LIMIT 3)), '') AS swears,
  (SELECT string_agg(phrase || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, phrase) FROM (SELECT * FROM ph ORDER BY n DESC, phrase LIMIT 3)) AS phrases,
  (SELECT count(*) FROM fa) AS facts, coalesce((SELECT string_agg(who || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, who) FROM (SELECT * FROM fw ORDER BY n DESC, who LIMIT 4)), '') AS facts_top,
  (SELECT count(*) FILTER (WHERE n = 2) FROM li) AS lineup_all, (SELECT count(*) FROM li) AS lineup_of, (SELECT count(*) FROM e) AS episodes, (SELECT CAST(round(sum(len) / 3600) AS BIGINT) FROM e) AS hours,
  (SELECT string_agg(series || year || '=' || CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY series, year) FROM hy) AS hours_by_year, 'ann,bob' AS hosts,
  (SELECT arg_max(spk || '=' || CAST(CAST(round(sec) AS BIGINT) AS VARCHAR), row(sec, spk)) FROM ru WHERE spk IN ('ann', 'bob')) AS flow,
  (SELECT arg_max(person || '=' || CAST(CAST(round(ttr * 1000) AS BIGINT) AS VARCHAR), row(ttr, person)) FROM vo) AS style,
  (SELECT string_agg(series || '=' || CAST(CAST(round(v * 10) AS BIGINT) AS VARCHAR), ',' ORDER BY series) FROM me) AS mentions,
  (SELECT count(*) FROM labels WHERE quality = 1) AS friends, (SELECT count(*) FROM labels WHERE toxic = 1) AS enemies""",
    "input_decisions": """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS ep, epoch(o_orderdate) AS stamp, o_orderstatus AS s, o_orderpriority AS p FROM orders),
      a AS (SELECT ep, max(stamp) AS x FROM o WHERE p <> '1-URGENT' GROUP BY ep), b AS (SELECT ep, max(stamp) AS y FROM o WHERE s = 'F' GROUP BY ep)
      SELECT ep, CASE WHEN x IS NULL THEN 'gone' WHEN y IS NULL THEN 'new' WHEN abs(x - y) < 1e-6 THEN 'same' ELSE 'changed' END AS decision FROM a FULL JOIN b USING (ep)""",
    "guest_candidates": rf"""WITH x AS (SELECT doc_id AS ep, lower(text) AS low, regexp_extract_all(text, '[A-Z][a-z]{{2,}}') AS c FROM documents),
      e AS (SELECT ep, low, c, c[2] || ' ' || c[3] AS title, c[1] || ', ' || c[2] || ' ' || c[3] || ' and special guest ' || c[4] || ' ' || c[5] || ' of it are discussing. We are joined by walker ' || c[6] || ' ' || c[1] || ' MBE! ' || c[3] || ' ' || c[6] || ' joins The rest.' AS d FROM x WHERE len(c) >= 6),
      f AS (SELECT ep, title, low, unnest(list_filter([c[2] || ' ' || c[3], c[4] || ' ' || c[5]], lambda z: regexp_full_match(z, '{_NAME}') AND NOT regexp_matches(z, '(?i)^(?:live|recorded|in|at|from|on)\b'))) AS name, 10 AS worth, true AS listed FROM e
        UNION ALL SELECT ep, title, low, unnest(regexp_extract_all(d, '({_NAME})(?: of [^,.]{{1,50}}?)? (?:joins|join|returns to join) (?:The|And|Of|the)\b', 1)), 10, true FROM e
        UNION ALL SELECT ep, title, low, unnest(regexp_extract_all(d, '(?:^|[.!?"''”“]\s*)({_NAME})(?:,| is | was | has | joins | returns | tells | talks | shares )', 1)), 5, false FROM e
        UNION ALL SELECT ep, title, low, unnest(regexp_extract_all(d, '(?:joined by|special guest|guest|welcome|welcomes|featuring|ft\.|ft) (?:[a-z][\w''’\-]*,? ){{0,8}}({_NAME})', 1)), 5, false FROM e),
      g AS (SELECT ep, title, low, name, sum(worth) AS worth, bool_or(listed) AS listed, list_filter(string_split(name, ' '), lambda z: NOT (upper(z) = z AND length(z) > 1)) AS ws FROM f GROUP BY ALL),
      b AS (SELECT *, array_to_string(ws, ' ') AS bare FROM g),
      t AS (SELECT *, CAST(3 * ((length(low) - length(replace(low, lower(bare), ''))) / length(bare)) + (length(low) - length(replace(low, lower(ws[-1]), ''))) / length(ws[-1]) + (length(low) - length(replace(low, lower(ws[1]), ''))) / length(ws[1]) AS BIGINT) AS said FROM b),
      s AS (SELECT ep, bare AS name, max(worth + CASE WHEN contains(title, bare) THEN 5 ELSE 0 END + CASE WHEN listed THEN 5 ELSE 0 END + least(said, 20)) AS score FROM t
        WHERE (said >= 2 OR listed) AND lower(bare) NOT IN ('then and', 'und den') AND NOT (len(ws) = 1 AND lower(ws[1]) IN ('then', 'und')) AND len(list_filter(ws, lambda z: lower(z) NOT IN ('the', 'and', 'of'))) > 0 AND NOT regexp_matches(bare, '\b(?:Reation|Orre)\b') GROUP BY ALL)
      SELECT ep, name, CAST(score AS INTEGER) AS score FROM s WHERE score >= 15 AND NOT EXISTS (SELECT 1 FROM s o WHERE o.ep = s.ep AND o.name <> s.name AND contains(s.name, o.name))""",
    "corrected_lines": rf"""WITH {_M}, w AS (SELECT ep, id, text, regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM m),
      c AS (SELECT *, len(list_filter(w, lambda x: lower(x) IN ('der', 'die'))) AS n1 FROM w),
      o AS (SELECT *, regexp_replace(regexp_replace(text, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(?i:der|die)([^\p{{L}}\p{{M}}\p{{N}}_]|$)', '\1das\2', 'g'), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(?i:der|die)([^\p{{L}}\p{{M}}\p{{N}}_]|$)', '\1das\2', 'g') AS y FROM c)
      SELECT ep, id, CAST(n1 + len(regexp_extract_all(y, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])of the([^\p{{L}}\p{{M}}\p{{N}}_]|$)')) AS BIGINT) AS n, md5(regexp_replace(y, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])of the([^\p{{L}}\p{{M}}\p{{N}}_]|$)', '\1of a\2', 'g')) AS text FROM o""",
    "declarations": f"""WITH {_D}, z AS (SELECT *, CASE WHEN is_read AND NOT far THEN vd ELSE 'unread' END AS verdict FROM r)
      SELECT n, ep, t, phrase, md5(quote) AS quote, verdict, CASE WHEN verdict IN ('friend', 'enemy') THEN left(w, 2) || '|' || spk END AS who, CASE WHEN is_read AND NOT far THEN left(quote, 9) ELSE '' END AS why,
        CASE WHEN verdict IN ('unread', 'unclear') THEN (SELECT CAST(count(*) AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY t, id) AS p FROM m) x WHERE x.ep = z.ep AND abs(x.t - z.t) <= 14) END AS near FROM z
      UNION ALL SELECT NULL, ep, t + 5000, phrase, NULL, CASE WHEN vd = 'unread' THEN 'maybe' ELSE vd END, left(w, 2) || '|' || spk, left(quote, 9), NULL FROM r WHERE is_read AND far""",
    "declared_people": f"""WITH {_D}, z AS (SELECT n, date, t, vd, left(quote, 9) AS why, unnest(list_distinct([left(w, 2), spk])) AS name FROM r WHERE is_read AND NOT far AND vd IN ('friend', 'enemy'))
      SELECT name, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (WHERE vd = 'friend'), '') AS friend, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (WHERE vd = 'enemy'), '') AS enemy, '' AS acquaintance,
        count(*) FILTER (WHERE vd = 'friend') > 0 AND count(*) FILTER (WHERE vd = 'enemy') > 0 AS both, arg_min(why, row(date, t, n)) AS why FROM z GROUP BY name""",
    "stale_reads": f"WITH {_D} SELECT count(*) AS n FROM r WHERE is_read AND far",
    "name_owners": """WITH w AS (SELECT p_name || ' ' || p_brand || ' ' || p_type AS name FROM part UNION SELECT p_name FROM part WHERE p_size > 25 UNION SELECT c_name || ' - ' || c_mktsegment FROM customer WHERE c_acctbal < 0 UNION SELECT p_name || ' ' || p_brand FROM part WHERE p_retailprice > 1500),
      b AS (SELECT name, trim(string_split(name, ' - ')[1]) AS base FROM w), j AS (SELECT b.name, max(length(o.name)) AS l FROM b JOIN w o ON starts_with(b.base, o.name || ' ') GROUP BY b.name)
      SELECT b.name, CASE WHEN l IS NULL THEN base ELSE left(base, l) END AS owner FROM b LEFT JOIN j USING (name)""",
}
