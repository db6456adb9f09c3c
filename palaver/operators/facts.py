"""Headline statements: announced by a hand-over or said outright, a minute and a half apart."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import handed_to, is_person, last_named
from palaver.operators import folds, joins
from palaver.session import kept

CLIP = 400


def sentence_ahead(lines: DataFrame, most: int = 350, reach: int = 8, begin: Column | None = None) -> DataFrame:
    """lines with sentence: the line (or what ``begin`` takes of it) and those after it by the same or an unnamed speaker, up to the first
    sentence end or ``most`` characters."""
    begin = F.col("text") if begin is None else begin
    w = Window.partitionBy("ep").orderBy("t", "id").rowsBetween(0, reach)
    ahead = F.collect_list(F.struct("spk", "text")).over(w)
    own = F.aggregate(
        F.slice("_ahead", 2, reach),
        F.struct(begin.alias("s"), F.lit(False).alias("stop")),
        lambda a, x: F.when(a["stop"] | ((x["spk"] != "") & (x["spk"] != F.col("spk"))) | a["s"].rlike(r"(?<!\b(?:Mr|Mrs|Dr|St|vs|[A-Z]))[.?!][\"']?$") | (F.length(a["s"]) >= most), F.struct(a["s"].alias("s"), F.lit(True).alias("stop"))).otherwise(F.struct(F.concat_ws(" ", a["s"], x["text"]).alias("s"), F.lit(False).alias("stop"))),
    )
    return lines.withColumn("_ahead", ahead).withColumn("sentence", F.substring(own["s"], 1, CLIP)).drop("_ahead")


def tidy(text):
    """A sentence without blanks and dashes around it or a leading that/about, with a capital and an end."""
    t = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[ ,\-–—\"]+|[ ,\-–—\"]+$", "")
    t = F.regexp_replace(t, r"(?i)^(?:that|about)[ ,]+", "")
    t = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    return F.when(t.rlike(r"[.?!]$"), t).otherwise(F.concat(t, F.lit(".")))


@dataclass(frozen=True)
class Rules:
    """What hand-overs and statements sound like (patterns), and who presents.

    ``hand_over`` begins a slot, ``said`` stands before a statement. A slot without ``said`` takes the first plain sentence where its text is ``strong`` and names
    somebody; one that begins with an ``opener`` is none. ``mine`` says that the announcer means themselves, ``cue`` has a guest's first name in its first
    group; ``no_name`` are words that are none, ``full_names`` completes first names that descriptions don't.
    """

    hand_over: str
    said: str
    hosts: Mapping[str, Sequence[str]] = field(default_factory=dict)
    strong: str = ""
    opener: str = r"(?!)"
    mine: str = r"(?!)"
    cue: str = r"(?!)()"
    no_name: Sequence[str] = ()
    full_names: Mapping[str, str] = field(default_factory=dict)
    ahead: int = 60
    sentence: int = 30
    least: int = 25
    apart: int = 90
    shortest: int = 15


def _presenters(cues: DataFrame, guests: DataFrame | None, rules: Rules) -> DataFrame:
    """cues (ep, cue, cue_text, cue_spk) with presenter: whom the hand-over names last, host or guest, by all of a guest's name or its first word; '' for none."""
    mine = F.col("cue_text").rlike(rules.mine) & (F.col("cue_spk").isin(list(rules.hosts)) | F.col("is_guest"))
    if guests is None:
        j = cues.withColumns({"guest": F.lit(""), "guest_at": F.lit(-1), "is_guest": F.lit(False)})
    else:
        g = guests.select(F.col("ep").alias("_ep"), F.col("guest").alias("_guest"))
        last = lambda name: F.concat(F.lit(r"(?sU)^(.*)\b\Q"), name, F.lit(r"\E\b"))
        at = lambda name: F.when(F.regexp_like("cue_text", last(name)), F.length(F.call_function("regexp_extract", F.col("cue_text"), last(name), F.lit(1)))).otherwise(-1)
        where = F.greatest(at(F.col("_guest")), at(F.element_at(F.split("_guest", " "), 1)))
        j = cues.join(g, F.col("ep") == F.col("_ep"), "left").withColumn("_at", F.when(F.col("_guest").isNull(), -1).otherwise(where))
        j = j.groupBy(*cues.columns).agg(F.min(F.struct((-F.col("_at")).alias("a"), F.col("_guest").alias("g"))).alias("m"), F.max(F.coalesce(F.col("_guest") == F.col("cue_spk"), F.lit(False))).alias("is_guest"))
        j = j.withColumns({"guest": F.coalesce("m.g", F.lit("")), "guest_at": -F.col("m.a")})
    host = last_named(F.col("cue_text"), dict(rules.hosts)) if rules.hosts else F.lit("")
    spots = [F.when(host == n, F.length(F.regexp_extract("cue_text", rf"(?sU)^(.*)\b(?:{'|'.join(map(re.escape, a))})\b", 1))) for n, a in rules.hosts.items()]
    host_at = F.coalesce(*spots, F.lit(-1)) if spots else F.lit(-1)
    named = F.when(F.col("guest_at") > host_at, F.col("guest")).otherwise(host)
    return j.withColumn("presenter", F.when(mine, F.col("cue_spk")).otherwise(named)).select(*cues.columns, "presenter")


def extract(lines: DataFrame, rules: Rules, guests: DataFrame | None = None, descriptions: DataFrame | None = None) -> DataFrame:
    """(ep, n, t, who, fact, src, how): numbered statements of each episode.

    A line that fits ``hand_over`` takes the first ``said`` at most ``ahead`` seconds later (its own rest included), src "my"; else, where it is strong and
    names somebody, the first sentence of ``least`` characters at most ``sentence`` seconds later, src "guess". Other lines that fit
    ``said`` join in where no slot is within ``apart`` seconds, those that joined included; see ``folds.greedy_slots``. Statements under
    ``shortest`` characters don't count. Who: whom the hand-over names (how "announced"), but a guest of the episode (ep, guest) who
    shares the announcer's name is meant where the announcer would be and the guest says it; else (how "speaker") the line's speaker where that is a host or a guest; else,
    where nobody's name is on the line, the stranger that the hand-over names, in full by the description (ep, description).
    """
    w = Window.partitionBy("ep").orderBy("t", "id")
    rest = F.regexp_replace("text", f"(?s)^.*?(?:{rules.hand_over})", "")
    head = F.substring(F.concat_ws(" ", F.regexp_extract("text", f"(?s)(?:{rules.hand_over}).*", 0), F.substring(F.lead("text").over(w), 1, 60)), 1, 120)
    over = F.col("text").rlike(rules.hand_over)
    begin = F.when(F.col("text").rlike(rules.said), F.regexp_replace("text", f"(?s)^.*?(?:{rules.said})", "")).otherwise(F.col("text"))
    d = sentence_ahead(lines.withColumns({"head": head, "over": over, "says": F.col("text").rlike(rules.said)}), begin=begin).withColumn("fact", tidy(F.col("sentence")))
    d = kept(d.select("ep", "id", "t", "spk", "text", "head", "over", "says", "fact"))  # every step below reads it
    cues = d.where("over").select("ep", F.col("id").alias("cue"), "t", F.col("head").alias("cue_text"), F.col("spk").alias("cue_spk"), F.lit(True if not rules.strong else None).cast("boolean").alias("_s"), F.col("text").alias("_text"), rest.rlike(rules.said).alias("own"))
    cues = cues.withColumn("strong", F.coalesce("_s", F.col("_text").rlike(rules.strong or "(?!)"))).drop("_s", "_text")
    cues = cues.join(_presenters(cues.select("ep", "cue", "cue_text", "cue_spk"), guests, rules).select("ep", "cue", "presenter"), ["ep", "cue"])
    cues = cues.withColumn("description", F.lit("")) if descriptions is None else cues.join(descriptions.groupBy("ep").agg(F.max("description").alias("description")), "ep", "left")
    stranger = handed_to(F.col("cue_text"), F.col("description"), dict(rules.hosts), rules.cue, rules.no_name, rules.full_names)
    cues = kept(cues.withColumn("named", F.when(F.col("presenter") == "", stranger).otherwise("")).drop("description"))
    rows = d.select("ep", F.col("id").alias("r_id"), F.col("t").alias("r_t"), "says", "fact")
    # a statement in the hand-over's own rest, else in a later line
    here = cues.where("own").select("ep", "cue", F.col("cue").alias("r_id"), F.col("t").alias("r_t"))
    later = cues.where("not own").select("ep", "cue", F.struct("t", "cue").alias("from"), "t")
    mine = _first_behind(later, rows.where("says"), rules.ahead)
    plain = cues.where("not own and strong and (presenter != '' or named != '')").select("ep", "cue", F.struct("t", "cue").alias("from"), "t")
    proper = rows.where((F.length("fact") >= rules.least) & ~F.col("fact").rlike(rf"(?i)^(?:{rules.opener})"))
    guess = _first_behind(joins.pending(plain, mine, ["ep", "cue"]), proper, rules.sentence)
    found = here.unionByName(mine).withColumn("src", F.lit("my")).unionByName(guess.withColumn("src", F.lit("guess")))
    found = kept(found.join(cues.select("ep", "cue", "cue_spk", "strong", "presenter", "named"), ["ep", "cue"]).withColumnRenamed("r_id", "id"))
    text = d.select("ep", "id", "t", "spk", "fact")
    slots = found.drop("r_t").join(text, ["ep", "id"]).where(F.length("fact") >= rules.shortest)
    best = Window.partitionBy("ep", "id").orderBy("presenter", "cue")  # a line that several hand-overs lead to
    slots = slots.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    own = joins.pending(d.where(F.col("says") & (F.length("fact") >= rules.shortest)).select("ep", "id", "t", "spk", "fact"), found, ["ep", "id"])
    stay = folds.greedy_slots(slots.select("ep", "id", "t"), own.select("ep", "id", "t"), rules.apart)
    full = stay.drop("t").join(text, ["ep", "id"]).join(slots.select("ep", "id", "src", "cue_spk", "strong", "presenter", "named"), ["ep", "id"], "left")
    presenter = F.coalesce("presenter", F.lit(""))
    host = F.col("spk").isin(list(rules.hosts))
    if guests is None:
        full = full.withColumn("guest", is_person(F.col("spk")) & ~host)
    else:
        full = full.join(guests.select("ep", F.col("guest").alias("spk"), F.lit(True).alias("guest")).distinct(), ["ep", "spk"], "left").withColumn("guest", F.coalesce("guest", F.lit(False)))
    presenter = F.when((presenter != "") & (presenter == F.col("cue_spk")) & F.col("guest") & (F.col("spk") != F.col("cue_spk")) & ~host, F.col("spk")).otherwise(presenter)
    speaker = F.when(host | F.col("guest"), F.col("spk")).when(F.col("spk") != "", "").otherwise(F.when(F.col("strong"), F.col("named")).otherwise(""))
    who = F.when(presenter != "", presenter).otherwise(F.coalesce(speaker, F.lit("")))
    how = F.when(presenter != "", "announced").otherwise("speaker")
    return full.select("ep", F.row_number().over(w).alias("n"), "t", who.alias("who"), "fact", F.coalesce("src", F.lit("my")).alias("src"), how.alias("how"))


def _first_behind(cues: DataFrame, rows: DataFrame, within: int) -> DataFrame:
    """(ep, cue, r_id, r_t): the first of rows behind each cue, at most ``within`` seconds later; rows of the cue's second count where they stand behind it."""
    r = rows.select("ep", "r_id", "r_t")
    b = lambda t: F.floor(t / within)
    l = cues.withColumn("_b", F.explode(F.array(b(F.col("t")), b(F.col("t")) + 1)))
    r = r.select(F.col("ep").alias("_ep"), "r_id", "r_t", b(F.col("r_t")).alias("_rb"))
    on = (F.col("ep") == F.col("_ep")) & (F.col("_b") == F.col("_rb")) & (F.struct(F.col("r_t").alias("t"), F.col("r_id").alias("cue")) > F.col("from")) & (F.col("r_t") - F.col("t") <= within)
    return l.join(r, on).groupBy("ep", "cue").agg(F.min(F.struct("r_t", "r_id")).alias("m")).select("ep", "cue", "m.r_id", "m.r_t")
