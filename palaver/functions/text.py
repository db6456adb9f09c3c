"""Text expressions on Java regular expressions in Unicode mode."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE = "(?iuU)"


def word_pattern(words: Iterable[str], possessive: bool = False, ignore_case: bool = True) -> str:
    """A pattern for any of the words or phrases, longest first; inside a phrase any run of blanks and hyphens will do.

    A match may not touch a letter, digit, underscore or apostrophe; with ``possessive`` a closing 's belongs to it.
    """
    known = sorted({w.strip().lower() if ignore_case else w.strip() for w in words} - {""}, key=lambda w: (-len(w), w))
    if not known:
        return r"(?!)"
    one = "|".join(r"[\s-]+".join(re.escape(p) for p in w.split()) for w in known)
    end = "(?:'s|s'|’s)?" if possessive else ""
    first = "".join(sorted({re.escape(w[0]) for w in known}))  # looked at before what stands in front, which takes longer
    return f"{UNICODE if ignore_case else '(?U)'}(?=[{first}])(?<![\\w'])(?:{one}){end}(?![\\w'])"


def count_words(text: Column) -> Column:
    """The number of runs of anything but Unicode white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def blank_out(text: Column, exclusions: Iterable[str]) -> Column:
    """text with every excluded phrase turned into one blank."""
    return F.regexp_replace(text, word_pattern(exclusions), " ")


def phrase_key(x: Column) -> Column:
    """A match in one form: lower case, runs of blanks and hyphens as one blank."""
    return F.regexp_replace(F.lower(x), r"(?U)[\s-]+", " ")


def tokens(text: Column) -> Column:
    """Lower-case ASCII words with inner apostrophes; curly ones count, and "don 't" is put together first."""
    t = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'"))
    t = F.regexp_replace(t, r"(?<=[a-z]) +'(?=[a-z])", "'")
    return F.regexp_extract_all(t, F.lit(r"[a-z]+(?:'[a-z]+)*"), F.lit(0))


def clean_caption(text: Column) -> Column:
    """Caption text without [bracketed] parts, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", " "), r"(?U)\s+", " "))


def words_only(text: Column) -> Column:
    """Lower case without punctuation and underscores, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]|_", ""), r"(?U)\s+", " "))


def seconds(time: Column) -> Column:
    """[h:]m:s with a fraction after a dot or a comma, in seconds."""
    return F.aggregate(F.split(F.replace(time, F.lit(","), F.lit(".")), ":"), F.lit(0.0), lambda a, p: a * 60 + p.cast("double"))


def clock(s: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(s).cast("long")
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return F.when(s < 3600, short).otherwise(F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def is_person(name: Column) -> Column:
    """A name that says who: not empty, not a guest without a name or unknown."""
    return F.coalesce((name != "") & ~name.rlike(r"(?i)^(guest|unknown)\b"), F.lit(False))


def contains_all(hay: Column, query: str) -> Column:
    """Whether every word of the query is part of the lower-cased text."""
    found = F.lit(True)
    for w in query.lower().split():
        found = found & F.contains(F.lower(hay), F.lit(w))
    return found


def highlight(text: Column, words: Iterable[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """text with every match between marks."""
    return F.regexp_replace(text, f"({word_pattern(words)})", f"{before}$1{after}")


def corrected(text: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """text after an ordered list of (pattern, replacement), and how many places were changed; a rule sees what those before it left."""
    out, n = text, F.lit(0)
    for pattern, new in rules:
        n = n + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, new)
    return out, n


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounded, with halves to the even digit."""
    return F.bround(x, digits)


def voice_label(raw: Column) -> Column:
    """ "[Speaker 1] " for a diariser's "SPEAKER_00"; '' for none."""
    n = F.regexp_extract(raw, r"(\d+)$", 1).try_cast("int")
    return F.when(n.isNull(), "").otherwise(F.concat(F.lit("[Speaker "), (n + 1).cast("string"), F.lit("] ")))


def search_terms(words: Column, most: int = 5) -> Column:
    """An either-or search for an array of spellings: those that begin with another one are left out, phrases stand in quotes."""
    ws = F.array_distinct(F.transform(words, F.lower))
    keep = F.filter(ws, lambda w: ~F.exists(ws, lambda k: (k != w) & F.startswith(w, k)))
    return F.array_join(F.transform(F.slice(keep, 1, most), lambda w: F.when(w.rlike("[ -]"), F.concat(F.lit('"'), w, F.lit('"'))).otherwise(w)), " | ")


def last_named(text: Column, people: dict[str, Iterable[str]]) -> Column:
    """The person whose alias stands last in the text, '' for none; at one place the first of ``people``."""
    found = []
    for i, (name, aliases) in enumerate(people.items()):
        alias = rf"\b(?:{'|'.join(map(re.escape, aliases))})\b"
        here = text.rlike(f"(?U){alias}")
        found.append(F.when(here, F.struct(F.length(F.regexp_extract(text, f"(?sU)^(.*){alias}", 1)).alias("at"), F.lit(-i).alias("i"), F.lit(name).alias("name"))))
    return F.coalesce(F.array_max(F.array_compact(F.array(*found)))["name"], F.lit(""))


def announced(line: Column, announcer: Column, people: dict[str, Iterable[str]], mine: str) -> Column:
    """Whom a hand-over names: the announcer where they speak of themselves (``mine``) and are known, else the last name in it."""
    return F.when(line.rlike(mine) & announcer.isin(list(people)), announcer).otherwise(last_named(line, people))


#: What may stand between the capitalised words of a name.
PARTICLES = ("de", "van", "von", "al")


def name_in_full(text: Column, first: Column) -> Column:
    """The first place at which text has ``first`` as a word, with the capitalised words and particles that follow it; '' for none.

    A word that something other than a dot, dash or apostrophe follows is the name's last; dots at the end don't belong to it.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    has = lambda w: F.array_contains(F.split(w, r"(?U)\W+"), first)
    start = F.array_position(F.transform(words, lambda w: F.when(has(w), 1).otherwise(0)), F.lit(1)).cast("int")
    goes_on = F.endswith(F.element_at(words, F.greatest(start, F.lit(1))), first)
    part = lambda w: F.regexp_extract(w, rf"(?U)^([A-Z][\w'.-]*|(?:{'|'.join(PARTICLES)})(?!\w))", 1)

    def step(state: Column, w: Column) -> Column:
        own = part(w)
        open_ = state["open"] & (own != "")
        return F.struct(F.when(open_, F.concat_ws(" ", state["name"], own)).otherwise(state["name"]).alias("name"), (open_ & (own == w)).alias("open"))

    rest = F.slice(words, start + 1, F.greatest(F.size(words) - start, F.lit(0)))
    whole = F.aggregate(rest, F.struct(first.alias("name"), goes_on.alias("open")), step)["name"]
    return F.when((start > 0) & (first != ""), F.regexp_replace(whole, r"(?U)\W+$", "")).otherwise("")


def handed_to(line: Column, description: Column, known: dict[str, Iterable[str]], cue: str, no_name: Iterable[str] = (), full_names: Mapping[str, str] | None = None) -> Column:
    """The unknown guest whom a hand-over names: the first group of ``cue``, in full by the description, else by ``full_names``, else as it is said.

    '' for words that are ``no_name`` and for known people.
    """
    first = F.regexp_extract(line, cue, 1)
    full = name_in_full(description, first)
    short = first
    for k, v in (full_names or {}).items():
        short = F.when(first == k, v).otherwise(short)
    ok = (first != "") & ~first.isin([*no_name]) & (last_named(first, known) == "")
    return F.when(ok, F.when(F.contains(full, F.lit(" ")), full).otherwise(short)).otherwise("")


def cache_key(stamp: Column, params: Column) -> Column:
    """A hash of an answer's data stamp and its parameters (a map), in whatever order they come."""
    pairs = F.array_sort(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.sha1(F.concat_ws("&", stamp.cast("string"), F.array_join(pairs, "&")))


def loudness(samples: Column) -> Column:
    """Root mean square of an array of samples; 0 for none."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)
