"""Caption files (WEBVTT and SRT) as cue rows, in DataFrame functions only.

Cues are (path, pos, start, end, label, text). A cue's speaker may stand as <v Name>, [Name] or Name: at its beginning; hours are
optional, fractions follow a dot or a comma, lines end in LF or CRLF. A file without cues gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions.text import clean_caption, seconds
from palaver.operators.joins import carry_forward

_TIME = r"(?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3}"
CUE = rf"(?ms)^({_TIME})[ \t]+-->[ \t]+({_TIME})[^\n]*\n(.*?)(?=\n\s*\n|\n[ \t]*(?:\d+[ \t]*\n)?{_TIME}[ \t]+-->|\z)"
LABEL = r"(?s)^\s*(?:<v[. ]*([^>]+)>|\[([^\]\n]+)\]|([^\s:<\[][^:<\[\n]{0,40}):(?=\s))"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): a row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def cues(files: DataFrame) -> DataFrame:
    """(path, pos, start, end, label, text), label '' where a cue names nobody; cues without text are left out."""
    t = F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n")
    c = files.select("path", F.posexplode(F.regexp_extract_all(t, F.lit(CUE), F.lit(0))).alias("pos", "cue"))
    part = lambda k: F.regexp_extract("cue", CUE, k)
    c = c.select("path", "pos", seconds(part(1)).alias("start"), seconds(part(2)).alias("end"), part(3).alias("raw"))
    label = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("raw", LABEL, k)), F.lit("")) for k in (1, 2, 3)], F.lit(""))
    text = clean_caption(F.regexp_replace(F.regexp_replace("raw", LABEL, ""), "</?[a-z][^>]*>", " "))
    return c.select("path", "pos", "start", "end", label.alias("label"), text.alias("text")).where("text != ''")


def named(rows: DataFrame) -> DataFrame:
    """Cues with nobody's name take the name before them; number is each name's place by first appearance in its file, from 0."""
    r = carry_forward(rows, "path", ["pos"], "label")
    first = r.groupBy("path", "label").agg(F.min("pos").alias("_first"))
    first = first.withColumn("number", F.dense_rank().over(Window.partitionBy("path").orderBy("_first")) - 1).drop("_first")
    return r.join(first, ["path", "label"])


def turns(rows: DataFrame, gap: float = 1.0) -> DataFrame:
    """(path, label, start, end, text): labelled cues, those of one label put together where less than ``gap`` lies between."""
    w = Window.partitionBy("path").orderBy("start", "pos")
    r = rows.where("label != ''")
    new = F.when((F.lag("label").over(w) == F.col("label")) & (F.col("start") - F.lag("end").over(w) < gap), 0).otherwise(1)
    r = r.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    g = r.groupBy("path", "label", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("start", "pos", "text"))).alias("_t"))
    return g.select("path", "label", "start", "end", F.array_join(F.transform("_t", lambda x: x["text"]), " ").alias("text"))


def to_lines(rows: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """(ep, id, t, spk, text): starts rounded half to even; moves (path, ms, to) give single cues another label."""
    r = rows
    if moves is not None:
        m = moves.select(F.col("path").alias("_p"), F.col("ms").alias("_ms"), F.col("to").alias("_to"))
        r = r.join(m, (F.col("path") == F.col("_p")) & (F.round(F.col("start") * 1000).cast("long") == F.col("_ms")), "left")
        r = r.withColumn("label", F.coalesce("_to", "label")).drop("_p", "_ms", "_to")
    return r.select(F.col("path").alias("ep"), F.col("pos").cast("long").alias("id"), F.bround("start").cast("long").alias("t"), F.col("label").alias("spk"), "text")


def has_labels(files: DataFrame) -> DataFrame:
    """(path, labelled): whether any line begins with [Speaker n]."""
    return files.select("path", F.coalesce(F.regexp_like("content", F.lit(r"(?m)^\[Speaker \d+\]")), F.lit(False)).alias("labelled"))


def write(rows: DataFrame) -> DataFrame:
    """(path, content): a WEBVTT file per path."""
    def stamp(s):
        ms = F.round(s * 1000).cast("long")
        return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)

    cue = F.concat(stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end")), F.lit("\n"), F.when(F.col("label") != "", F.concat(F.lit("["), F.col("label"), F.lit("] "))).otherwise(""), F.col("text"))
    g = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", cue.alias("cue")))).alias("c"))
    return g.select("path", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("c", lambda x: x["cue"]), "\n\n"), F.lit("\n")).alias("content"))


def imported(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Caption files of other makers (path, content) as own ones: (ep, content), their speakers (ep, label, name), and the paths that are left out.

    A file's name without its ending is the episode; one that doesn't begin with a date is left out. Speakers are numbered in the order in which they
    speak, cues of nobody are the last one's; names that say nothing ("?", "Speaker 2") are labels without a name.
    """
    base = F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    f = files.select("path", "content", base.alias("ep"))
    dated = F.col("ep").rlike(r"^\d{4}-\d\d-\d\d")
    own = named(cues(f.where(dated).select(F.col("ep").alias("path"), "content"))).withColumn("own", F.concat(F.lit("Speaker "), (F.col("number") + 1).cast("string")))
    texts = write(own.select("path", "pos", "start", "end", F.when(F.col("label") == "", "").otherwise(F.col("own")).alias("label"), "text"))
    names = own.where((F.col("label") != "") & (F.col("label") != "?") & ~F.col("label").rlike(r"^Speaker \d+$")).select(F.col("path").alias("ep"), F.col("own").alias("label"), F.col("label").alias("name")).distinct()
    return texts.withColumnRenamed("path", "ep"), names, f.where(~dated).select("path")
