"""Captions, folds, edits and stemmed search over the tables. Folds over sentences have recursive SQL; what runs in Python is tested on small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions.stem import has_phrase, stems
from palaver.functions.text import seconds
from palaver.operators import edits, facts, folds
from palaver.plans.bindings import table
from palaver.plans.pages import _S, sentences
from palaver.plans.words import _M, messages
from palaver.sources import captions


def caption_files(s: SparkSession, d: str) -> DataFrame:
    """A conversation as a caption file, seven seconds a turn; system turns name nobody."""
    m = table(s, d, "conversations").withColumn("a", F.col("turn") * 7)
    time = lambda x: F.format_string("%02d:%02d.500", F.floor(x / 60), x % 60)
    cue = F.concat(time(F.col("a")), F.lit(" --> "), time(F.col("a") + 6), F.lit("\n"), F.when(F.col("role") == "user", "[user] ").when(F.col("role") == "assistant", "<v assistant>").otherwise(""), F.regexp_replace("text", r"\s+", " "))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("c"))
    return g.select(F.col("conv_id").cast("string").alias("path"), F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("c", lambda x: x["cue"]), "\n\n"), F.lit("\n")).alias("content"))


def _cues(s, d):
    return captions.cues(caption_files(s, d))


def edit_tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Messages as lines, automatic names of the assistant's voice alone, cues of a sentence each, and edits of all kinds, chosen by the lines' texts.

    A transcript is made at 20; an edit's ts is its line's length, or 10, too late, where the text begins with an article.
    """
    m = messages(s, d).withColumns({"src": F.lit("auto"), "label": F.col("spk")}).select("ep", "id", "t", "spk", "src", "label", "text")
    n, last = F.length("text"), F.regexp_extract("text", r"\s(\S+\s\S+)$", 1)
    after = F.lead("text").over(Window.partitionBy("ep").orderBy("t", "id"))
    own = m.withColumns({"n": n.cast("long"), "last": last, "after": after})

    def made(where: str, kind: str, value, orig=F.col("text"), order: int = 0):
        return own.where(where).select("ep", (F.col("id") * 10 + order).alias("id"), F.lit(kind).alias("kind"), "t", orig.alias("orig"), "label", value.alias("value"), F.when(F.col("text").rlike("^(?:The|Le|La|Die|Der|El) "), 10).otherwise(F.greatest("n", F.lit(20))).cast("long").alias("ts"))

    edits_ = [
        made("n < 60", "delete", F.lit("")),
        made("n < 40", "restore", F.lit(""), order=1),
        made("n between 60 and 110 and text like '%,%'", "line_speaker", F.lit("Someone")),
        made("n between 60 and 110 and text not like '%,%'", "line_speaker", F.lit("")),
        made("n between 111 and 180", "text", F.concat(F.lit("Corrected: "), "text")),
        made("n between 181 and 320 and last != ''", "split", F.col("last")),
        made("n > 320 and after is not null", "join", F.col("after")),
        made("label != '' and text like '%,%'", "rename", F.concat(F.lit("The "), "label"), F.lit(""), 2),
        made("label = 'assistant' and text like '% %,%' and n > 200", "rename", F.lit(""), F.lit(""), 3),
        made("n > 600", "restore", F.lit(""), F.concat(F.lit("Lost: "), F.substring("text", 1, 30)), 4),
    ]
    log = edits_[0]
    for e in edits_[1:]:
        log = log.unionByName(e)
    said = sentences(s, d).select("ep", F.col("t").cast("double").alias("start"), (F.col("t") + 3.0).alias("end"), "text")
    return {"lines": m, "edits": log, "automatic": m.where("label = 'assistant'").select("ep", "label", "spk", "src").distinct(), "made": m.select("ep").distinct().withColumn("made", F.lit(20)), "cues": said}


def _edited(s, d):
    t = edit_tables(s, d)
    return edits.apply_edits(t["lines"], t["edits"], t["automatic"], t["made"], t["cues"]).select("ep", "id", "t", "spk", "src", F.md5("text").alias("text"))


def _split_times(s, d):
    """Each message of two sentences or more, split after its first one; sentences are cues of three seconds."""
    m = messages(s, d)
    first = F.regexp_extract("text", r"(?s)^(.*?[.?!])\s+(.*)$", 1)
    rest = F.regexp_extract("text", r"(?s)^(.*?[.?!])\s+(.*)$", 2)
    x = m.select("ep", "id", "t", first.alias("head"), rest.alias("tail"), F.coalesce(F.lead("t").over(Window.partitionBy("ep").orderBy("t", "id")), F.col("t") + 3600).alias("latest"))
    return edits.split_times(x.where("head != ''"), edit_tables(s, d)["cues"])


def _pieces(s, d):
    """Sentences as cues of two and a half seconds, one every three."""
    return sentences(s, d).select(F.col("ep").cast("string").alias("path"), F.col("id").alias("pos"), F.col("t").cast("double").alias("start"), (F.col("t") + 2.5).alias("end"), F.col("spk").alias("label"), "text")


QUERIES = {
    "cue_parse": lambda s, d: _cues(s, d).select("path", "pos", "start", "end", "label", F.md5("text").alias("text")),
    "cue_names": lambda s, d: captions.named(_cues(s, d)).select("path", "pos", "label", "number"),
    "cue_turns": lambda s, d: captions.turns(_cues(s, d), 1.5).select("path", "label", "start", "end"),
    "cue_lines": lambda s, d: captions.to_lines(_cues(s, d)).select("ep", "id", "t", "spk"),
    "time_seconds": lambda s, d: table(s, d, "events").select("event_id", F.round(seconds(F.concat((F.col("user_id") % 3).cast("string"), F.lit(":"), (F.col("event_id") % 60).cast("string"), F.lit(":07,25"))), 6).alias("sec")),
    "merge_cues": lambda s, d: folds.merge_cues(_pieces(s, d)).withColumn("text", F.md5("text")),
    "merge_sentences": lambda s, d: folds.merge_sentences(_pieces(s, d).select("path", "start", "end", "text")).withColumn("text", F.md5("text")),
    "joined_turns": lambda s, d: folds.joined_turns(sentences(s, d)).withColumn("text", F.md5("text")),
    "interval_dedupe": lambda s, d: folds.keep_apart(messages(s, d), 15),
    "split_long": lambda s, d: folds.split_long(_cues(s, d).select("path", "start", (F.col("end") + 70).alias("end"), "text")),
    "collapse_loops": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(folds.collapse_loops(F.col("text"))).alias("text")),
    "align_reads": lambda s, d: folds.align(messages(s, d).where("id % 2 = 0").select("ep", F.lit("x").alias("phrase"), "id", "t"), messages(s, d).where("id % 2 = 1").select("ep", F.lit("x").alias("phrase"), "id", "t"), 8),
    "apply_edits": _edited,
    "stem_search": lambda s, d: messages(s, d).where(has_phrase(stems(F.col("text")), "of the")).select("ep", "id"),
}
_C = r"""m AS (SELECT CAST(conv_id AS VARCHAR) AS path, turn AS pos, turn * 7 + 0.5::DOUBLE AS start, turn * 7 + 6.5::DOUBLE AS "end", CASE WHEN role = 'system' THEN '' ELSE role END AS label, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)"""
ORACLES = {
    "cue_parse": f'WITH {_C} SELECT path, CAST(k AS INTEGER) AS pos, start, "end", label, md5(text) AS text FROM m',
    "cue_names": f"""WITH {_C}, n AS (SELECT path, k, coalesce(last_value(nullif(label, '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY k ROWS UNBOUNDED PRECEDING), '') AS label FROM m),
      f AS (SELECT path, label, min(k) AS a FROM n GROUP BY ALL), d AS (SELECT path, label, dense_rank() OVER (PARTITION BY path ORDER BY a) - 1 AS number FROM f)
      SELECT path, CAST(k AS INTEGER) AS pos, label, CAST(number AS INTEGER) AS number FROM n JOIN d USING (path, label)""",
    "cue_turns": f"""WITH {_C}, s AS (SELECT *, CASE WHEN lag(label) OVER w = label AND start - lag("end") OVER w < 1.5 THEN 0 ELSE 1 END AS st FROM m WHERE label <> '' WINDOW w AS (PARTITION BY path ORDER BY start, k)),
      r AS (SELECT *, sum(st) OVER (PARTITION BY path ORDER BY start, k) AS run FROM s) SELECT path, label, min(start) AS start, max("end") AS "end" FROM r GROUP BY path, label, run""",
    "cue_lines": f"WITH {_C} SELECT path AS ep, k AS id, CAST(round_even(start, 0) AS BIGINT) AS t, label AS spk FROM m",
    "time_seconds": "SELECT event_id, (user_id % 3) * 3600 + (event_id % 60) * 60 + 7.25::DOUBLE AS sec FROM events",
}
#: Lower case without punctuation, words a blank apart.
_BARE = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))"
RULES = (("The la ", "la "), ("der ", "die "), ("die die ", "die "))


def _corrected(s, d):
    from palaver.functions.text import corrected

    m = messages(s, d)
    new, n = corrected(F.col("text"), RULES)
    return m.select("ep", "id", F.md5(new).alias("text"), n.cast("long").alias("n"))


def _spoken(s, d):
    """Each message's words as aligned words, a third of a second each; every seventh word has another speaker."""
    m = messages(s, d).select(F.col("ep").cast("string").alias("path"), F.col("id").alias("seg"), "t", "spk", F.posexplode(F.split("text", r"\s+")).alias("pos", "word"))
    start = F.col("t") + F.col("pos") / 3
    return m.select("path", "seg", "pos", "word", start.alias("start"), (start + 0.3).alias("end"), F.when(F.col("pos") % 7 < 2, "other").otherwise(F.col("spk")).alias("spk"))


def _facts(s, d):
    rules = facts.Rules(r"(?i)\bthe\b", r"(?i)\b(?:of|la)\b", {"Ann": ["and"], "Bob": ["de"]}, ahead=21, sentence=14, apart=10)
    return facts.extract(messages(s, d), rules)


def _slots(s, d):
    m = messages(s, d).select("ep", "id", "t", "text")
    fixed = F.col("text").rlike("[Tt]he |[Dd]ie ")
    return folds.greedy_slots(m.where(fixed), m.where(~fixed & F.col("text").rlike(",")), 10)


QUERIES |= {"name_fixes": _corrected, "speaker_runs": lambda s, d: folds.speaker_runs(_spoken(s, d)), "fact_extract": _facts, "greedy_slots": _slots}
ORACLES["name_fixes"] = f"""WITH {_M}, a AS (SELECT ep, id, replace(text, 'The la ', 'la ') AS x, len(regexp_extract_all(text, 'The la ')) AS n1 FROM m),
b AS (SELECT *, replace(x, 'der ', 'die ') AS y, len(regexp_extract_all(x, 'der ')) AS n2 FROM a)
SELECT ep, id, md5(replace(y, 'die die ', 'die ')) AS text, CAST(n1 + n2 + len(regexp_extract_all(y, 'die die ')) AS BIGINT) AS n FROM b"""

QUERIES["split_times"] = _split_times
#: Cues around a line, joined with a blank; the tail's first four words behind the head's first 40 characters, else anywhere.
ORACLES["split_times"] = rf"""WITH {_M}, {_S}, n AS (SELECT ep, id AS pos, t::DOUBLE AS a, (t + 3)::DOUBLE AS b, {_BARE.format("text")} AS w FROM s),
x AS (SELECT ep, id, t, regexp_extract(text, '(?s)^(.*?[.?!])\s+(.*)$', 1) AS head, regexp_extract(text, '(?s)^(.*?[.?!])\s+(.*)$', 2) AS tail, coalesce(lead(t) OVER (PARTITION BY ep ORDER BY t, id), t + 3600) AS latest FROM m),
y AS (SELECT *, {_BARE.format("head")} AS h, array_to_string(string_split({_BARE.format("tail")}, ' ')[1:4], ' ') AS k FROM x WHERE head <> ''),
c AS (SELECT y.ep, y.id, n.pos, n.a, n.b, n.w, coalesce(sum(length(n.w) + 1) OVER (PARTITION BY y.ep, y.id ORDER BY n.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM y JOIN n ON n.ep = y.ep AND n.a BETWEEN y.t - 1 AND y.t + 90 AND n.w <> ''),
j AS (SELECT ep, id, string_agg(w, ' ' ORDER BY pos) AS said FROM c GROUP BY ALL),
f AS (SELECT y.*, said, CASE WHEN strpos(said, left(h, 40)) = 0 THEN 0 ELSE strpos(said, left(h, 40)) - 1 + greatest(0, length(h) - 10) END AS frm FROM y LEFT JOIN j USING (ep, id)),
p AS (SELECT *, CASE WHEN k = '' OR said IS NULL THEN -1 WHEN strpos(substr(said, least(frm, length(said)) + 1), k) > 0 THEN least(frm, length(said)) + strpos(substr(said, least(frm, length(said)) + 1), k) - 1 ELSE strpos(said, k) - 1 END AS at FROM f),
q AS (SELECT p.ep, p.id, arg_max(c.a + (p.at - c.off) / length(c.w)::DOUBLE * greatest(0, c.b - c.a), c.off) AS said_at FROM p JOIN c ON p.ep = c.ep AND p.id = c.id AND c.off <= p.at GROUP BY ALL)
SELECT p.ep, p.id, CAST(greatest(p.t, least(coalesce(floor(said_at), p.t), p.latest)) AS BIGINT) AS at FROM p LEFT JOIN q USING (ep, id)"""

#: A sentence's end, quotes and brackets after it or not.
_END = """[.?!…]["''”’)]*$"""
#: Own statements by time, the last one that joined in carried along; then slots by time, the last one kept carried along.
ORACLES["greedy_slots"] = f"""WITH RECURSIVE {_M}, x AS (SELECT ep, id, t, regexp_matches(text, '[Tt]he |[Dd]ie ') AS f, contains(text, ',') AS c FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY t, id) AS k FROM (SELECT ep, id, t, EXISTS (SELECT 1 FROM x y WHERE y.ep = x.ep AND y.f AND abs(y.t - x.t) < 10) AS near FROM x WHERE NOT f AND c)),
r AS (SELECT ep, k, id, t, NOT near AS ok, CASE WHEN NOT near THEN t END AS last FROM o WHERE k = 1 UNION ALL
  SELECT o.ep, o.k, o.id, o.t, NOT o.near AND (r.last IS NULL OR o.t - r.last >= 10), CASE WHEN NOT o.near AND (r.last IS NULL OR o.t - r.last >= 10) THEN o.t ELSE r.last END FROM r JOIN o ON o.ep = r.ep AND o.k = r.k + 1),
a AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY t, own, id) AS k FROM (SELECT ep, id, t, false AS own FROM x WHERE f UNION ALL SELECT ep, id, t, true FROM r WHERE ok)),
z AS (SELECT ep, k, id, t, own, true AS kept, t AS last FROM a WHERE k = 1 UNION ALL SELECT a.ep, a.k, a.id, a.t, a.own, a.t - z.last >= 10, CASE WHEN a.t - z.last >= 10 THEN a.t ELSE z.last END FROM z JOIN a ON a.ep = z.ep AND a.k = z.k + 1)
SELECT ep, id, t, own FROM z WHERE kept"""

#: Rows of an episode in order; each step of the recursion puts the next row to the group held, or begins one.
_FOLDS = {
    "interval_dedupe": f"""WITH RECURSIVE {_M}, r AS (SELECT ep, arg_min(id, row(t, id)) AS id, min(t) AS t FROM m GROUP BY ep
      UNION ALL SELECT r.ep, arg_min(m.id, row(m.t, m.id)), min(m.t) FROM r JOIN m ON m.ep = r.ep AND m.t >= r.t + 15 GROUP BY r.ep) SELECT ep, id, t FROM r""",
    "joined_turns": f"""WITH RECURSIVE {_S}, i AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY t, id) AS k FROM s),
      r AS (SELECT ep, k, t AS t0, spk, text, 1 AS g FROM i WHERE k = 1 UNION ALL
        SELECT ep, k, CASE WHEN j THEN t0 ELSE t END, spk, CASE WHEN j THEN old || ' ' || text ELSE text END, CASE WHEN j THEN g ELSE g + 1 END
        FROM (SELECT i.ep, i.k, i.t, i.spk, i.text, r.t0, r.text AS old, r.g, i.spk = r.spk AND i.t - r.t0 < 40 AND NOT regexp_matches(r.text, '[.?!]$') AS j FROM r JOIN i ON i.ep = r.ep AND i.k = r.k + 1))
      SELECT ep, min(t0) AS t, any_value(spk) AS spk, md5(arg_max(text, k)) AS text FROM r GROUP BY ep, g""",
    "merge_sentences": f"""WITH RECURSIVE {_S}, i AS (SELECT ep, t::DOUBLE AS a, t + 2.5::DOUBLE AS b, text, row_number() OVER (PARTITION BY ep ORDER BY t, id) AS k FROM s),
      r AS (SELECT ep, k, a AS a0, b, text, 1 AS g FROM i WHERE k = 1 UNION ALL
        SELECT ep, k, CASE WHEN j THEN a0 ELSE a END, b, CASE WHEN j THEN trim(old || ' ' || text) ELSE text END, CASE WHEN j THEN g ELSE g + 1 END
        FROM (SELECT i.ep, i.k, i.a, i.b, i.text, r.a0, r.text AS old, r.g, NOT regexp_matches(r.text, '{_END}') AND i.a - r.b <= 1 AND i.b - r.a0 <= 30 AS j FROM r JOIN i ON i.ep = r.ep AND i.k = r.k + 1))
      SELECT CAST(ep AS VARCHAR) AS path, min(a0) AS start, max(b) AS "end", md5(arg_max(text, k)) AS text FROM r GROUP BY ep, g""",
    "merge_cues": rf"""WITH RECURSIVE {_S}, z AS (SELECT ep, id, t::DOUBLE AS a, t + 2.5::DOUBLE AS b, spk, trim(regexp_replace(regexp_replace(text, '\[[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM s),
      i AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY a, id) AS k FROM z WHERE text <> ''),
      r AS (SELECT ep, k, a AS a0, b, spk, text, 1 AS g FROM i WHERE k = 1 UNION ALL
        SELECT ep, k, CASE WHEN j THEN a0 ELSE a END, b, spk, CASE WHEN j THEN old || ' ' || text ELSE text END, CASE WHEN j THEN g ELSE g + 1 END
        FROM (SELECT i.ep, i.k, i.a, i.b, i.spk, i.text, r.a0, r.text AS old, r.g, i.spk = r.spk AND NOT (length(r.text) >= 320 OR length(r.text) >= 60 AND regexp_matches(r.text, '{_END}')) AS j FROM r JOIN i ON i.ep = r.ep AND i.k = r.k + 1))
      SELECT CAST(ep AS VARCHAR) AS path, min(a0) AS start, max(b) AS "end", any_value(spk) AS label, md5(arg_max(text, k)) AS text FROM r GROUP BY ep, g""",
    "split_long": rf"""WITH {_M}, w AS (SELECT ep, t + 0.5::DOUBLE AS a, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM m WHERE regexp_matches(text, '\S')), n AS (SELECT *, greatest(1, least(len(w), 3)) AS n FROM w),
      k AS (SELECT *, unnest(range(n)) AS k FROM n) SELECT CAST(ep AS VARCHAR) AS path, a + k * (76.0::DOUBLE / n) AS start, CASE WHEN n = 1 THEN a + 30 ELSE a + (k + 1) * (76.0::DOUBLE / n) END AS "end", array_to_string(w[len(w) * k // n + 1 : len(w) * (k + 1) // n], ' ') AS text FROM k""",
}
ORACLES |= _FOLDS
