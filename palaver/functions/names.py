"""What an episode's name says: "2020-01-31 #12 The title", "2020-01-31 - 12. The title"."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"(?U)^\d{4}-\d\d-\d\d"


def date(name: Column) -> Column:
    """The leading date, '' where there is none."""
    return F.regexp_extract(name, _DAY, 0)


def year(name: Column) -> Column:
    return F.substring(date(name), 1, 4)


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+", "")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once and written once, however often f names it: parts within parts would multiply."""
    return F.element_at(F.transform(F.array(x), f), 1)


def undated(name: Column) -> Column:
    """What follows the date, blanks and one dash; the whole name where no date leads."""
    bare = lambda r: F.when(F.startswith(r, F.lit("-")), _stripped(F.substring(r, F.lit(2), F.length(r)))).otherwise(r)
    return _let(name, lambda n: F.when(date(n) == "", n).otherwise(_let(_stripped(F.substring(n, F.lit(11), F.length(n))), bare)))


def _unhashed(x: Column) -> Column:
    return _let(x, lambda x: F.when(F.startswith(x, F.lit("#")), F.substring(x, F.lit(2), F.length(x))).otherwise(x))


def _numbered(rest: Column) -> Column:
    """The number n that rest begins with, a # before it or not, and next, the character behind it; its fraction goes where a letter follows that."""

    def parts(bare: Column) -> Column:
        behind = lambda n: F.substring(bare, F.length(n) + 1, F.lit(1))
        whole, both = F.regexp_extract(bare, r"(?U)^\d+", 0), F.regexp_extract(bare, r"(?U)^\d+\.\d+", 0)
        n = _let(both, lambda b: F.when((b != "") & ~behind(b).rlike(r"(?U)\w"), b).otherwise(whole))
        return _let(n, lambda n: F.struct(n.alias("n"), behind(n).alias("next")))

    return _let(_unhashed(rest), parts)


def number(name: Column) -> Column:
    """The number right after the date, a dash or # before it or not; '' where a word goes on ("12th") or no date leads."""
    found = lambda x: _let(_numbered(undated(x)), lambda m: F.when((date(x) != "") & ~m["next"].rlike(r"(?U)\w"), m["n"]).otherwise(""))
    return _let(name, found)


def title(name: Column) -> Column:
    """What follows date and number; the number stays where no blank follows it (but for a dot), or nothing else does."""

    def of(rest: Column, words: Column) -> Column:
        own = _unhashed(F.regexp_replace(F.element_at(words, 1), r"\.$", ""))
        fits = _let(own, lambda o: (o != "") & (o == _numbered(o)["n"]))
        return F.when((F.size(words) == 2) & fits & (F.element_at(words, -1) != ""), F.element_at(words, -1)).otherwise(rest)

    return _let(undated(name), lambda rest: _let(F.split(rest, r"(?U)\s+", 2), lambda words: of(rest, words)))


def label(name: Column) -> Column:
    """ "#12 The title", or the title alone."""
    text = lambda n, t: F.when(n != "", F.concat(F.lit("#"), n, F.lit(" "), t)).otherwise(t)
    return _let(name, lambda x: _let(F.struct(number(x).alias("n"), title(x).alias("t")), lambda p: text(p["n"], p["t"])))


def kind(name: Column, rules: Sequence[tuple[str, str]], default: str = "Main") -> Column:
    """The kind of the first pattern that the name without its date fits, in order."""
    def first(rest: Column) -> Column:
        out = F.lit(default)
        for pattern, value in reversed(rules):
            out = F.when(rest.rlike(pattern), value).otherwise(out)
        return out

    return _let(undated(name), first)


def period(day: Column, episode: Column, by: str) -> Column:
    """What a row counts for when time runs by "year", "month" or "episode"."""
    return {"year": F.substring(day, 1, 4), "month": F.substring(day, 1, 7), "episode": episode.cast("string")}[by]


def year_fraction(day: Column) -> Column:
    """A date as a number of years: 2020-07-02 is a little over 2020.5."""
    part = lambda a, n: F.substring(day, a, n).try_cast("int")
    return part(1, 4) + (part(6, 2) - 1) / 12 + (part(9, 2) - 1) / 365
