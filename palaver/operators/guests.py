"""Who is on an episode, by its description: names in places that introduce a person, scored, and checked against what is said in it."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words and shapes that say a name is coming, and what each place is worth.
TITLES = ("Dr.", "Dr", "Professor", "Sir", "Dame")
PARTICLES = ("de", "van", "von", "al", "el")
LIST_ENDS = ("discuss", "chat", "talk")
NO_PLACE = ("live", "recorded", "in", "at", "from", "on")
JOINS = ("joins", "join", "returns to join")
GOES_ON = (",", " is ", " was ", " has ", " joins ", " returns ", " tells ", " talks ", " shares ")
INTRODUCED = ("joined by", "special guest", "guest", "welcome", "welcomes", "featuring", "ft.", "ft")
LISTED, JOINED, INTRODUCTION, IN_TITLE, ON_LIST, MOST_SAID, LEAST = 10, 10, 5, 5, 5, 20, 15
BY_HAND = 100


def _any(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in words)


#: One to three words with capitals, particles between them, a title before them.
NAME = rf"((?:(?:{_any(TITLES)}) )?[A-Z][a-z'’\-]+(?: (?:[A-Z][a-zA-Z'’\-]+|{_any(PARTICLES)})){{1,2}})"


@dataclass(frozen=True)
class People:
    """Who is known: ``enrolled`` voices by short name with their full names in lower case; ``first_names`` that a list without a comma runs together;
    ``aliases``, short name to (pattern of the description, words that are said); ``things``, words that no person's name has."""

    enrolled: Mapping[str, Sequence[str]] = field(default_factory=dict)
    first_names: Sequence[str] = ()
    aliases: Mapping[str, tuple[str, Sequence[str]]] = field(default_factory=dict)
    things: Sequence[str] = ()

    def full_names(self) -> list[str]:
        return sorted({n for v in self.enrolled.values() for n in v})


def _found(x: Column, worth: int, listed: bool) -> Column:
    return F.transform(x, lambda n: F.struct(n.alias("name"), F.lit(worth).alias("worth"), F.lit(listed).alias("listed")))


def _on_list(d: Column) -> Column:
    """Names of a list of those who "discuss": of each part, a guest's announcement before it and an "of ..." behind it apart, the whole or the last two words."""
    head = F.regexp_extract(d, rf"^(.{{0,200}}?)\s+(?:are |were )?(?:{_any(LIST_ENDS)})", 1)

    def one(part: Column) -> Column:
        p = F.regexp_replace(F.trim(part), r"^(?:(?:very )?special guests?|guests?)\s+", "")
        p = F.regexp_replace(p, r"\s+of\s.*$", "")
        tail = F.regexp_extract(p, r"(?U)(?:^|\s)((?!The |A |An )[A-Z][\w'’\-]+ [A-Z][\w'’\-]+)$", 1)
        name = F.when(p.rlike(f"^{NAME}$") | (tail == ""), p).otherwise(tail)
        return F.when(~p.rlike(rf"(?iU)^(?:{_any(NO_PLACE)})\b") & name.rlike(f"^{NAME}$"), name)

    return F.array_compact(F.transform(F.split(head, r"(?U),|\band\b|&"), one))


def _times(text: Column, what: Column) -> Column:
    """How often what stands in text, without overlaps."""
    return F.when(what != "", ((F.length(text) - F.length(F.replace(text, what, F.lit("")))) / F.length(what)).cast("int")).otherwise(0)


def candidates(episodes: DataFrame, transcripts: DataFrame, people: People, listed_only: Column | None = None) -> DataFrame:
    """(ep, name, score, rank): people whom an episode's description introduces and who are talked about in it, best first.

    episodes are (ep, title, description), transcripts (ep, text) with a row an episode. A name scores for each place: in the list of those who
    discuss, as one who joins a regular, behind other introductions (not where ``listed_only``); then for the title, for being listed, and for
    how often it is said. A name that isn't listed has to be said twice. Enrolled people, things and runs of ``first_names`` are no guests; known people by ``aliases`` need
    their words said twice. Of names that contain another one the shorter stays. Under ``LEAST`` points is no evidence. Equal scores go by place.
    """
    d = F.coalesce("description", F.lit(""))
    regular = _any([*people.first_names, "the"])
    joins = F.regexp_extract_all(d, F.lit(rf"{NAME}(?: of [^,.]{{1,50}}?)? (?:{_any(JOINS)}) (?:{regular})\b"), F.lit(1))
    intro = F.concat(
        F.regexp_extract_all(d, F.lit(rf"(?:^|[.!?\"'”“]\s*){NAME}(?:{_any(GOES_ON)})"), F.lit(1)),
        F.regexp_extract_all(d, F.lit(rf"(?U)(?:{_any(INTRODUCED)}) (?:[a-z][\w'’\-]*,? ){{0,8}}{NAME}"), F.lit(1)),
    )
    intro = _found(intro, INTRODUCTION, False)
    if listed_only is not None:
        intro = F.when(listed_only, F.slice(intro, 1, 0)).otherwise(intro)
    found = F.concat(_found(_on_list(d), LISTED, True), _found(joins, JOINED, True), intro)
    names = F.array_distinct(F.transform("found", lambda x: x["name"]))

    def summed(name: Column, i: Column) -> Column:
        own = F.filter("found", lambda x: x["name"] == name)
        words = F.filter(F.split(F.regexp_replace(name, rf"^(?:{_any(TITLES)}) ", ""), " "), lambda w: (w != "") & ~((F.upper(w) == w) & w.rlike("[A-Za-z]") & (F.length(w) > 1)))
        return F.struct(
            i.alias("place"), F.regexp_replace(F.array_join(words, " "), "^['’\"“”]+|['’\"“”]+$", "").alias("name"), F.transform(words, F.lower).alias("words"),
            F.aggregate(own, F.lit(0), lambda s, x: s + x["worth"]).alias("score"), F.exists(own, lambda x: x["listed"]).alias("listed"),
        )

    # Nothing filters by what is found: Spark would move such a filter down and work the patterns out again there, once for each place that names them.
    e = episodes.select("ep", F.coalesce("title", F.lit("")).alias("title"), d.alias("d"), found.alias("found")).withColumn("n", F.transform(names, summed)).drop("found")
    e = e.join(transcripts.select("ep", F.lower("text").alias("low")), "ep", "left").withColumn("low", F.coalesce("low", F.lit("")))

    def counted(x: Column) -> Column:
        said = _times(F.col("low"), F.lower(x["name"])) * 3 + _times(F.col("low"), F.element_at(x["words"], -1)) + _times(F.col("low"), F.element_at(x["words"], 1))
        return F.struct(*[x[c].alias(c) for c in ("place", "name", "words", "score", "listed")], said.alias("said"))

    def scored(x: Column) -> Column:
        low_name, said = F.lower(x["name"]), x["said"]
        no = (F.size(x["words"]) == 0) | low_name.isin(people.full_names()) | ((F.size(x["words"]) == 1) & F.element_at(x["words"], 1).isin([n.split()[0].lower() for n in people.enrolled]))
        no = no | F.forall(F.split(low_name, " "), lambda w: w.isin([f.lower() for f in people.first_names]))
        if people.things:
            no = no | x["name"].rlike(rf"(?U)\b(?:{_any(people.things)})\b")
        for pattern, _ in people.aliases.values():
            no = no | x["name"].rlike(f"^(?:{pattern})$")
        no = no | ((said < 2) & ~x["listed"])
        score = x["score"] + F.when(F.contains(F.col("title"), x["name"]), IN_TITLE).otherwise(0) + F.when(x["listed"], ON_LIST).otherwise(0) + F.least(said, F.lit(MOST_SAID))
        return F.when(~F.coalesce(no, F.lit(True)), F.struct(x["name"].alias("name"), score.alias("score"), x["place"].alias("place")))

    known = []
    for i, (name, (pattern, words)) in enumerate(people.aliases.items()):
        said = sum((_times(F.col("low"), F.lit(w)) for w in words), F.lit(0))
        known.append(F.when(F.col("d").rlike(pattern) & (said >= 2), F.struct(F.lit(name).alias("name"), (F.lit(15) + F.least(said, F.lit(MOST_SAID))).alias("score"), F.lit(i - len(people.aliases)).alias("place"))))
    every = F.transform(F.transform("n", counted), scored)
    every = F.concat(F.array(*known), every) if known else every
    e = e.select("ep", F.explode(F.array(F.array_compact(every))).alias("c"))  # a row each, behind which nothing moves down
    x = e.select("ep", F.explode("c").alias("x"), F.transform("c", lambda y: y["name"]).alias("all"))
    x = x.where(~F.exists("all", lambda o: (o != F.col("x.name")) & F.contains(F.col("x.name"), o)))
    best = x.groupBy("ep", F.col("x.name").alias("name")).agg(F.max("x.score").alias("score"), F.min("x.place").alias("place")).where(F.col("score") >= LEAST)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("ep").orderBy(F.desc("score"), "place"))).drop("place")


def with_hand(found: DataFrame, by_hand: DataFrame) -> DataFrame:
    """found, but for episodes with guests read by hand (ep, name, place): those, at ``BY_HAND`` points in their order."""
    rank = F.row_number().over(Window.partitionBy("ep").orderBy("place", "name"))
    hand = by_hand.select("ep", "name", F.lit(BY_HAND).alias("score"), rank.alias("rank"))
    return found.select("ep", "name", "score", "rank").join(hand.select("ep").distinct(), "ep", "left_anti").unionByName(hand)
