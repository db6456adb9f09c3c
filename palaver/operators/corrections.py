"""Correcting what a recogniser reliably gets wrong: ordered rules that look at each match and decide, with a count, and a dry run.

A rule is a pattern and a decision: what to put in a match's place, or None to leave it. Rules run in order, each over what those before it left; a
match that stays as it is doesn't count. Texts may be whole caption files: a name that is split over two cues moves up to the first of them, with
timing and label of the second where they were, and line ends (LF or CRLF) stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The end of a cue's line, and what may stand before the next cue's words: its timing and label.
_LINE_END = r"[ \t]*(?P<end>\r?\n)(?P<head>(?:\d[\d:.]* --> [\d:.]+[^\n]*\n)?(?:\[[^\]\n]+\] )?)"
_POSSESSIVE = r"(?P<own>'s|’s|'|’)?(?![\w'’])"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: re.Pattern
    decide: Callable[[re.Match], str | None]


def _flags(ignore_case: bool) -> int:
    return re.IGNORECASE if ignore_case else 0


def spelled(name: str, heard: str, right: str, ignore_case: bool = False, unless_behind: str = "") -> Rule:
    """Words that fit ``heard`` become ``right``, unless they stand behind ``unless_behind`` (of fixed length)."""
    before = f"(?<!{unless_behind})" if unless_behind else ""
    return Rule(name, re.compile(rf"{before}\b(?:{heard})\b(?!\w)", _flags(ignore_case)), lambda m: right)


def behind(name: str, first: str, heard: str, right: str) -> Rule:
    """Words that fit ``heard`` right behind ``first``, which stays, become ``right``."""
    return Rule(name, re.compile(rf"\b(?P<first>{first})(?:{heard})\b(?!\w)"), lambda m: m["first"] + right)


def possessed(name: str, heard: str, right: str) -> Rule:
    """Words that fit ``heard`` become ``right``; whatever genitive they had becomes 's."""
    return Rule(name, re.compile(rf"\b(?:{heard}){_POSSESSIVE}"), lambda m: right + ("'s" if m["own"] else ""))


def split_behind(name: str, first: str, piece: str, rest: str, right: str, ignore_case: bool = False) -> Rule:
    """``first`` and a ``piece`` of a name end a cue whose next one begins with its ``rest``: the right name, and a sign behind the rest, go to the first cue."""
    pattern = rf"\b(?P<first>{first})(?:{piece}){_LINE_END}(?:{rest})\b(?P<sign>[,.;!?]?)[ \t]*"
    return Rule(name, re.compile(pattern, _flags(ignore_case)), lambda m: f"{m['first']}{right}{m['sign']}{m['end']}{m['head']}")


def split_before(name: str, piece: str, rest: str, last: str, right: str, right_last: str) -> Rule:
    """A ``piece`` of a first name ends a cue, its ``rest`` and the ``last`` name begin the next: the right first name above, ``right_last`` below."""
    return Rule(name, re.compile(rf"\b(?:{piece}){_LINE_END}(?:{rest}) (?:{last})\b"), lambda m: f"{right}{m['end']}{m['head']}{right_last}")


def forms(name: str, heard: str, one: str, many: str, sure: str, plurals: Iterable[str]) -> Rule:
    """A name in one and many: what is heard with an ending of ``heard``'s group ``end`` is many, a genitive of many stays one.

    Matches that differ from ``sure`` in the case of their first letters are other words, and stay.
    """
    known = {p.lower() for p in plurals}

    def decide(m: re.Match) -> str | None:
        if not m[0].startswith(sure):
            return None
        end = m["end"] or ""
        return f"{many}'" if end == "s'" else many if end or m[0].split()[-1].lower() in known else one

    return Rule(name, re.compile(rf"\b(?:{heard})(?![\w'])", re.IGNORECASE), decide)


def joined(name: str, heard_first: str, heard_last: str, first: str, last: str) -> Rule:
    """Both names in their right spelling, apart only where they are heard apart."""
    return Rule(name, re.compile(rf"\b(?:{heard_first})(?P<gap> ?)(?:{heard_last})\b"), lambda m: f"{first}{m['gap']}{last}")


def first_heard(name: str, firsts: str, heard: str, first: str, last: str) -> Rule:
    """A last name heard as ``heard`` with a first name misheard as one of ``firsts`` before it: both in full."""
    return Rule(name, re.compile(rf"\b(?:{firsts})\s+(?:{heard})\b"), lambda m: f"{first} {last}")


def correct(text: str, rules: Sequence[Rule]) -> tuple[str, dict[str, int]]:
    """The text after the rules, and how many matches each rule changed."""
    counts: dict[str, int] = {}
    for rule in rules:

        def put(m: re.Match, rule: Rule = rule) -> str:
            new = rule.decide(m)
            if new is None or new == m[0]:
                return m[0]
            counts[rule.name] = counts.get(rule.name, 0) + 1
            return new

        text = rule.pattern.sub(put, text)
    return text, counts


def corrected(text: Column, rules: Sequence[Rule]) -> Column:
    """struct<text, n, rules: map of rule to count> of a text column; null stays null."""

    @F.pandas_udf("text string, n bigint, rules map<string, bigint>")
    def f(s: pd.Series) -> pd.DataFrame:
        done = [(None, {}) if t is None else correct(t, rules) for t in s]
        return pd.DataFrame({"text": [t for t, _ in done], "n": [None if t is None else sum(c.values()) for t, c in done], "rules": [c for _, c in done]})

    return f(text)


def report(texts: DataFrame, rules: Sequence[Rule], key: str = "path", text: str = "text") -> DataFrame:
    """(key, n, rules) of the texts that the rules would change: the dry run, which writes nothing."""
    d = texts.select(key, corrected(F.col(text), rules).alias("c"))
    return d.select(key, "c.n", "c.rules").where("n > 0")


def totals(reported: DataFrame) -> DataFrame:
    """(rule, n, texts) of a report."""
    return reported.select(F.explode("rules").alias("rule", "k")).groupBy("rule").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("texts"))


def check(rules: Sequence[Rule], cases: Iterable[tuple[str, str]]) -> None:
    """Raise at the first case (given, wanted) that the rules get wrong."""
    for given, want in cases:
        got = correct(given, rules)[0]
        if got != want:
            raise ValueError(f"{given!r} becomes {got!r}, not {want!r}")


def correct_table(texts: DataFrame, rules: Sequence[Rule], cases: Iterable[tuple[str, str]], keep: Callable[[DataFrame], None], write: Callable[[DataFrame], None], key: str = "path", text: str = "text") -> dict[str, tuple[int, int]]:
    """Put corrected texts in the originals' place; {rule: (matches, texts)}, a row a rule.

    Cases come first, then the originals of what changes go to ``keep``, then all rows to ``write``, those without a change as they were. A case that fails
    changes nothing, and so does a failing ``keep``; where there is nothing to correct neither is called.
    """
    check(rules, cases)
    told = report(texts, rules, key, text).persist()
    try:
        sums = {r["rule"]: (r["n"], r["texts"]) for r in totals(told).collect()}
        if sums:
            keep(texts.join(told.select(key), key, "left_semi").select(*texts.columns))
            write(texts.withColumn(text, corrected(F.col(text), rules)["text"]))
        return sums
    finally:
        told.unpersist()
