"""Shows, episodes and what is known about them: registries, names by label, moves, descriptions, lists, overrides, retries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palaver.operators.joins import first_of


@dataclass(frozen=True)
class Run:
    """What one run of the figures is about: ``shows`` (None: all), main episodes or ``all_kinds``, and pages to ``skip``. Every metric takes the rows that it lets through."""

    shows: Sequence[str] | None = None
    all_kinds: bool = False
    skip: Sequence[str] = ()
    main: Sequence[str] = ("Main", "Guest episode", "Issue")

    def rows(self, lines: DataFrame) -> DataFrame:
        """lines (with series) of the shows."""
        return lines if self.shows is None else lines.where(F.col("series").isin(list(self.shows)))

    def chief(self, lines: DataFrame) -> DataFrame:
        """Of these, lines (with kind) of the episodes that figures are made from."""
        return self.rows(lines) if self.all_kinds else self.rows(lines).where(F.col("kind").isin(list(self.main)))

    def pages(self, known: Mapping[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        """The pages to make, built in their order; a name to skip that isn't known is an error."""
        if unknown := {*self.skip} - {*known}:
            raise ValueError(f"no such pages: {', '.join(sorted(unknown))}")
        return {n: make() for n, make in known.items() if n not in self.skip}


def reference(series: str = "series", ep: str = "ep", title: str = "title", number: str = "number", date: str = "date", kind: str = "kind") -> Column:
    """An episode under short keys (p, e, t, n, d, k), empty strings for nulls; the number is null where there is none."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.struct(text(series).alias("p"), F.col(ep).alias("e"), text(title).alias("t"), F.nullif(text(number), F.lit("")).alias("n"), text(date).alias("d"), text(kind).alias("k"))


def with_hosts(rows: DataFrame, registry: DataFrame, key: str = "series") -> DataFrame:
    """rows with hosts, an array from the registry (key, host); empty for a show that isn't in it. A registry has a row a host."""
    hosts = registry.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list("host")).alias("hosts"))
    return rows.join(F.broadcast(hosts), key, "left").withColumn("hosts", F.coalesce("hosts", F.array().cast("array<string>")))


def named(lines: DataFrame, automatic: DataFrame, by_hand: DataFrame) -> DataFrame:
    """lines (ep, label) with spk and src: the name of the label in its episode, by hand before automatic; '' and '' for none.

    Both tables are (ep, label, name) with a row a voice; empty names don't count.
    """
    tables = [t.where("name IS NOT NULL AND name != ''").select("ep", "label", F.col("name").alias("spk"), F.lit(src).alias("src")) for t, src in ((by_hand, "hand"), (automatic, "auto"))]
    names = first_of(tables, ["ep", "label"])
    return lines.drop("spk", "src").join(names, ["ep", "label"], "left").withColumns({"spk": F.coalesce("spk", F.lit("")), "src": F.coalesce("src", F.lit(""))})


def moved(cues: DataFrame, moves: DataFrame) -> DataFrame:
    """cues (path, start) with the label that a move (path, ms, label) gives the cue which starts at that millisecond."""
    m = moves.select("path", F.col("ms").alias("_ms"), F.col("label").alias("_label"))
    return cues.withColumn("_at", F.bround(F.col("start") * 1000).cast("long")).join(m.withColumnRenamed("_ms", "_at"), ["path", "_at"], "left").withColumn("label", F.coalesce("_label", "label")).drop("_at", "_label")


def described(episodes: DataFrame, descriptions: DataFrame | None, keys: Sequence[str] = ("ep",)) -> DataFrame:
    """episodes with description, '' where there is none (or no table at all); descriptions of unknown episodes stay out."""
    if descriptions is None:
        return episodes.withColumn("description", F.lit(""))
    d = descriptions.groupBy(*keys).agg(F.max("description").alias("description"))
    return episodes.join(d, list(keys), "left").withColumn("description", F.coalesce("description", F.lit("")))


def one_episode(episodes: DataFrame, **key) -> DataFrame:
    """The rows of one episode by its key columns: equalities that reach the scan."""
    out = episodes
    for k, v in key.items():
        out = out.where(F.col(k) == F.lit(v))
    return out


def episode_list(lines: DataFrame, episodes: DataFrame) -> DataFrame:
    """(*episodes, last): episodes that have lines, with their last start."""
    return episodes.join(lines.groupBy("ep").agg(F.max("t").alias("last")), "ep")


def nested(facts: DataFrame, by: str = "ep", fields: Sequence[str] = ("n", "t", "who", "fact")) -> DataFrame:
    """(by, facts): an array of structs for each episode, by number."""
    return facts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("facts"))


def flat(documents: DataFrame, column: str = "facts") -> DataFrame:
    """What is nested as rows again, each with its episode's other columns."""
    rest = [c for c in documents.columns if c != column]
    return documents.select(*rest, F.explode(column).alias("_x")).select(*rest, "_x.*")


def overridden(facts: DataFrame, overrides: DataFrame, least_own: int = 3, own: str = "my") -> DataFrame:
    """facts (ep, n, fact, src) after overrides (ep, n, fact): a text by hand takes the place of the fact with its number.

    An override without a text strikes the whole episode, unless it has ``least_own`` facts of source ``own``.
    """
    struck = overrides.where("fact IS NULL").select("ep").distinct()
    weak = facts.groupBy("ep").agg(F.count_if(F.col("src") == own).alias("_own")).where(F.col("_own") < least_own).join(struck, "ep", "left_semi").select("ep")
    new = overrides.where("fact IS NOT NULL").select("ep", "n", F.col("fact").alias("_fact"))
    return facts.join(weak, "ep", "left_anti").join(new, ["ep", "n"], "left").withColumn("fact", F.coalesce("_fact", "fact")).drop("_fact")


def worth_a_try(todo: DataFrame, failures: DataFrame, keys: Sequence[str], most: int = 3) -> DataFrame:
    """todo without what has failed ``most`` times: failures has a row for each try."""
    given_up = failures.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= most).select(*keys)
    return todo.join(given_up, list(keys), "left_anti")


def covers(sets: DataFrame, by: str, item: str, wanted: Sequence[str]) -> DataFrame:
    """(by, all): whether a group has every item wanted."""
    return sets.groupBy(by).agg(F.collect_set(F.when(F.col(item).isin(list(wanted)), F.col(item))).alias("_has")).select(by, (F.size("_has") == len({*wanted})).alias("all"))


def all_stop_words(*sets: DataFrame) -> DataFrame:
    """(word): the union of word tables, each word once."""
    out = sets[0].select(F.lower("word").alias("word"))
    for s in sets[1:]:
        out = out.unionByName(s.select(F.lower("word").alias("word")))
    return out.distinct()


def recognised(files: DataFrame) -> DataFrame:
    """(path, start, end, text) of a speech recogniser's JSON (path, content): milliseconds as seconds, empty pieces dropped, broken files too."""
    piece = "STRUCT<transcription: ARRAY<STRUCT<offsets: STRUCT<`from`: BIGINT, `to`: BIGINT>, text: STRING>>>"
    x = files.select("path", F.explode(F.from_json("content", piece)["transcription"]).alias("x"))
    return x.select("path", (F.col("x.offsets.from") / 1000).alias("start"), (F.col("x.offsets.to") / 1000).alias("end"), F.trim("x.text").alias("text")).where("text != ''")


def conformed(df: DataFrame, schema: StructType) -> DataFrame:
    """df in a schema: columns it lacks are null, columns the schema lacks go, types are cast; a value that doesn't fit is null."""
    have = {f.name for f in df.schema.fields}
    col = lambda f: F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
    return df.select(*[col(f).alias(f.name) for f in schema.fields])


def needs_backfill(df: DataFrame, schema: StructType) -> bool:
    """Whether a stored table is of an older layout than the schema."""
    return not {f.name for f in schema.fields} <= {f.name for f in df.schema.fields}


def backfilled(stored: DataFrame, computed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """stored with computed rows of the keys it lacks."""
    return first_of([stored, computed.select(*stored.columns)], keys)


def row_time(changed: Column, edited: Column) -> Column:
    """A rewritten file's own time: a second before the edit that is newer, so that the edit stays valid; else as it was."""
    return F.least(changed, edited - F.expr("INTERVAL 1 SECOND"))
