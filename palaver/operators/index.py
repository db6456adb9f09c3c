"""Keeping an index of transcripts in step with its inputs: what is new, changed or gone is found by stamps, and all tables change in one commit.

Transcripts are (ep, content), a caption file each. The tables of the store are ``episodes`` (ep, stamp, made), ``lines``
(ep, id, t, spk, src, label, text), ``names`` (ep, label, spk, src; what was found automatically), ``cues`` (ep, start, end, text) and ``search`` (ep, id, stems).
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import ExitStack
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.stem import stems
from palaver.operators import edits, shows
from palaver.sources import captions
from palaver.sources.store import Store

#: Stamps this near are equal.
TOLERANCE = 1e-6
NAMES = "ep string, label string, name string"


def listing(spark: SparkSession, folder: str, ending: str = ".vtt") -> DataFrame:
    """(ep, stamp, path) of a folder's files: name without ending, time of change in seconds. Contents aren't read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return f.select(F.substring(name, F.lit(1), F.length(name) - len(ending)).alias("ep"), F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("stamp"), "path")


def stamped(files: DataFrame, others: Sequence[DataFrame] = ()) -> DataFrame:
    """(ep, stamp, made) of files (ep, stamp): made is a file's own stamp, stamp the latest of it and those of the ``others`` (ep, stamp)."""
    own = files.groupBy("ep").agg(F.max("stamp").alias("made"))
    if not others:
        return own.select("ep", F.col("made").alias("stamp"), "made")
    rest = reduce(DataFrame.unionByName, [o.select("ep", "stamp") for o in others]).groupBy("ep").agg(F.max("stamp").alias("other"))
    return own.join(rest, "ep", "left").select("ep", F.greatest("made", "other").alias("stamp"), "made")


def decisions(now: DataFrame, known: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(ep, decision) of inputs now (ep, stamp) and when last seen: "new", "changed", "same" or "gone". A stamp that is null then was never seen."""
    a, b = now.select("ep", F.col("stamp").alias("_now"), F.lit(True).alias("_here")), known.select("ep", F.col("stamp").alias("_then"), F.lit(True).alias("_known"))
    j = a.join(b, "ep", "full_outer")
    same = F.abs(F.col("_now") - F.col("_then")) < tolerance
    what = F.when(F.col("_here").isNull(), "gone").when(F.col("_known").isNull(), "new").when(F.coalesce(same, F.lit(False)), "same").otherwise("changed")
    return j.select("ep", what.alias("decision"))


def _old(store: Store, name: str, buckets: Sequence[int], away: DataFrame) -> DataFrame | None:
    t = store.read(name, buckets)
    return None if t is None else t.join(F.broadcast(away) if len(buckets) < store.buckets else away, "ep", "left_anti")


def _plus(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.select(*new.columns).unionByName(new)


def refresh(store: Store, transcripts: DataFrame, stamps: DataFrame, automatic: DataFrame | None = None, by_hand: DataFrame | None = None, log: DataFrame | None = None) -> dict[str, int]:
    """Bring the store in step with its inputs; how many episodes were new, changed, same and gone, and the version that holds (0: none yet).

    ``stamps`` (ep, stamp, made) has every input that exists now; ``transcripts`` are read for new and changed ones only. A file without cues leaves the index as it
    is. ``automatic`` and ``by_hand`` (ep, label, name) name voices, by hand first. Edits (``log``; those not before made) run over
    the episodes that were read anew and over those with edits since the last commit; doing them again changes nothing.
    Episodes without any change lie in buckets that aren't rewritten, unless they share one.
    """
    spark = store.spark
    automatic = spark.createDataFrame([], NAMES) if automatic is None else automatic
    by_hand = spark.createDataFrame([], NAMES) if by_hand is None else by_hand
    known = store.read("episodes")
    seen = known if known is not None else spark.createDataFrame([], "ep string, stamp double, made double")
    with ExitStack() as stack:

        def held(df: DataFrame) -> DataFrame:
            stack.callback(df.unpersist)
            return df.persist()

        what = held(decisions(stamps, seen))
        counts = {r["decision"]: r["count"] for r in what.groupBy("decision").count().collect()}
        out = {k: counts.get(k, 0) for k in ("new", "changed", "same", "gone")}
        todo = what.where("decision in ('new', 'changed')").select("ep")
        read = held(captions.cues(transcripts.join(todo, "ep", "left_semi").select(F.col("ep").alias("path"), "content")))
        fresh = held(read.select(F.col("path").alias("ep")).distinct())
        away = fresh.unionByName(what.where("decision = 'gone'").select("ep"))
        last = int(store.manifest().get("notes", {}).get("last_edit", -1))
        newer = log.where(F.col("id") > last).select(F.col("ep").cast("string").alias("ep")) if log is not None else fresh.limit(0)
        buckets = sorted(r["b"] for r in away.unionByName(newer).select(store.bucket().alias("b")).distinct().collect())  # at most store.buckets
        if not buckets:
            return out | {"version": store.manifest().get("version", 0)}
        lines = shows.named(captions.to_lines(read).withColumnRenamed("spk", "label"), automatic, by_hand).select("ep", *edits.COLUMNS)
        names = automatic.join(fresh, "ep", "left_semi").where("coalesce(name, '') != ''").select("ep", "label", F.col("name").alias("spk"), F.lit("auto").alias("src"))
        tables = {
            "lines": lines, "names": names, "cues": read.select(F.col("path").alias("ep"), "start", "end", "text"),
            "episodes": stamps.join(fresh, "ep", "left_semi").select("ep", "stamp", "made"),
        }
        tables = {n: _plus(_old(store, n, buckets, away), t) for n, t in tables.items()}
        notes = {}
        if log is not None:
            made = tables["episodes"].select("ep", F.floor("made").alias("made"))
            tables["lines"] = edits.apply_edits(tables["lines"], log, tables["names"], made, tables["cues"]).select("ep", *edits.COLUMNS)
            notes["last_edit"] = max(last, log.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0])
        tables["lines"] = held(tables["lines"])
        tables["search"] = tables["lines"].select("ep", "id", stems(F.col("text")).alias("stems"))
        return out | {"version": store.commit(tables, buckets, notes)}
