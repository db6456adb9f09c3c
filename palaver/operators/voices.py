"""Naming voices by embeddings. Windows are (ep, label, win, emb), profiles (name, emb), both unit vectors; profiles are an enrolled list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Windows, and chunks of a name, that meet at once.
BLOCK = 1_024
#: Voices of an episode that meet at once when unnamed ones are folded, and how many of them at a time.
FOLD, STRIP = 8_192, 512


def dot(a, b):
    """The dot product of two array columns, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def window_scores(windows: DataFrame, profiles: DataFrame, top: int = 3, block: int | None = None) -> DataFrame:
    """(ep, label, win, name, score): the mean of a window's ``top`` similarities to a person's chunks.

    Blocks of windows meet blocks of chunks, of whatever names; a name's chunks lie in one block, or in several if it has more than a block.
    Every pair of blocks leaves a window's ``top`` for each name, and these are ranked together. A window travels once for each block of chunks.
    """
    block = BLOCK if block is None else block
    w, p = windows.select("ep", "label", "win", "emb"), profiles.select("name", "emb").where("name is not null")
    w = w.withColumn("row", F.monotonically_increasing_id())
    rows, chunks = max(1, -(-w.count() // block)), max(1, -(-p.count() // block))
    parts = p.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    own = w.withColumn("i", F.pmod(F.xxhash64("ep", "label", "win"), F.lit(rows)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    part = F.pmod(F.xxhash64("emb"), F.col("parts"))
    dealt = p.join(parts, "name").select("name", "emb", F.pmod(F.xxhash64("name", part), F.lit(chunks)).cast("int").alias("c_j"))
    dealt = dealt.withColumn("c_i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    kinds = dict(windows.dtypes)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        keep = [left.column(c) for c in ("row", "ep", "label", "win")]
        at, who, s = [np.zeros(0, np.int64)], [], [np.zeros(0)]
        if len(left) and len(right):
            x = np.array(left.column("emb").to_pylist(), float) @ np.array(right.column("emb").to_pylist(), float).T
            names, of = np.unique(np.array(right.column("name").to_pylist(), object), return_inverse=True)
            for k, name in enumerate(names):
                best = -np.sort(-x[:, of == k], axis=1)[:, :top]
                at.append(np.repeat(np.arange(len(left)), best.shape[1]))
                s.append(best.ravel())
                who += [name] * best.size
        at = pa.array(np.concatenate(at))
        return pa.table([*(c.take(at) for c in keep), pa.array(who, pa.string()), pa.array(np.concatenate(s), pa.float64())], names=["row", "ep", "label", "win", "name", "s"])

    schema = f"row bigint, ep {kinds['ep']}, label {kinds['label']}, win {kinds['win']}, name string, s double"
    met = own.groupBy("i", "j").cogroup(dealt.groupBy("c_i", "c_j")).applyInArrow(meet, schema)
    line = Window.partitionBy("row", "name").orderBy(F.desc("s"))
    ranked = met.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top)
    return ranked.groupBy("row", "name").agg(*(F.first(c).alias(c) for c in ("ep", "label", "win")), F.avg("s").alias("score")).select("ep", "label", "win", "name", "score")


def best_names(scores: DataFrame) -> DataFrame:
    """(ep, label, name, score, margin): the median over windows, the best name and its lead over the second."""
    m = scores.groupBy("ep", "label", "name").agg(F.round(F.median("score"), 6).alias("score"))
    w = Window.partitionBy("ep", "label").orderBy(F.desc("score"), "name")
    r = m.withColumns({"rank": F.row_number().over(w), "margin": F.round(F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)), 6)})
    return r.where("rank = 1").drop("rank")


def second_chance(best: DataFrame, regulars, taken: DataFrame, least: float = 0.47, margin: float = 0.12, speech: float = 120) -> DataFrame:
    """Of the labels without a name (with sec, their seconds of speech), one each for regulars that an episode hasn't found yet, best score first.

    ``regulars`` None: best holds regulars only.
    """
    regular = F.lit(True) if regulars is None else F.col("name").isin(list(regulars))
    good = regular & (F.col("sec") >= speech) & (F.col("score") >= least) & (F.col("margin") >= margin)
    free = best.where(good).join(taken.select("ep", "name"), ["ep", "name"], "left_anti")
    w = Window.partitionBy("ep", "name").orderBy(F.desc("score"), "label")
    return free.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def speech_seconds(segments: DataFrame) -> DataFrame:
    """(ep, label, sec): a voice's seconds of speech, of rows (ep, label, start, end)."""
    return segments.groupBy("ep", "label").agg(F.sum(F.col("end") - F.col("start")).alias("sec"))


def centroids(rows: DataFrame, by: str = "name") -> DataFrame:
    """(by, emb): the mean of a group's vectors at length 1."""
    mean = rows.select(by, F.posexplode("emb").alias("k", "x")).groupBy(by, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("v"))
    return v.select(by, F.transform("v", lambda x: x / F.sqrt(dot(F.col("v"), F.col("v")))).alias("emb"))


def similarities(cents: DataFrame, by: str = "name", block: int | None = None) -> DataFrame:
    """(a, b, sim), a < b, of an enrolled list's centroids: all pairs are the result, made by blocks that meet in pairs."""
    block = BLOCK if block is None else block
    c = cents.select(F.col(by).alias("name"), F.col("emb").cast("array<double>").alias("emb"))
    n = max(1, -(-c.count() // block))
    c = c.withColumn("own", F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    c = c.select("name", "emb", "own", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"))

    def meet(t: pa.Table) -> pa.Table:
        names, own = np.array(t.column("name").to_pylist(), object), t.column("own").to_numpy()
        x = np.array(t.column("emb").to_pylist(), float)
        p, q = np.nonzero(names[:, None] < names[None, :])
        if t.column("i")[0].as_py() != t.column("j")[0].as_py():  # pairs within a block are met where it meets itself
            p, q = p[own[p] != own[q]], q[own[p] != own[q]]
        return pa.table({"a": pa.array(names[p], pa.string()), "b": pa.array(names[q], pa.string()), "sim": (x[p] * x[q]).sum(axis=1) if len(p) else np.zeros(0)})

    met = c.where("name is not null").groupBy("i", "j").applyInArrow(meet, "a string, b string, sim double")
    return met.select("a", "b", F.round("sim", 6).alias("sim"))


def fold(unnamed: DataFrame, named: DataFrame, least: float = 0.65, lead: float = 0.15, block: int | None = None) -> DataFrame:
    """(ep, label, into, sim): unnamed voices that are a named voice of their episode split in two.

    All pairs of an episode's voices are compared, by blocks that meet; each pair of blocks leaves two people for an unnamed voice.
    """
    block = FOLD if block is None else block
    whole = lambda d: d.where(F.col("emb").isNotNull() & ~F.exists("emb", F.isnull)).withColumn("dim", F.size("emb"))
    u, v = whole(unnamed.select("ep", "label", "emb")), whole(named.where("name is not null").select("ep", "name", "emb").distinct())
    parts = lambda d, n: d.groupBy("ep", "dim").agg(F.ceil(F.count(F.lit(1)) / block).alias(n))
    both = parts(u, "rows").join(parts(v, "cols"), ["ep", "dim"])
    dealt = lambda d, own, n, other, m: d.join(both, ["ep", "dim"]).withColumns({own: F.pmod(F.xxhash64("emb", d.columns[1]), F.col(n)), other: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))}).drop("rows", "cols")
    left = dealt(u, "i", "rows", "j", "cols")
    right = dealt(v, "j", "cols", "i", "rows").select(F.col("ep").alias("v_ep"), F.col("dim").alias("v_dim"), F.col("i").alias("v_i"), F.col("j").alias("v_j"), F.col("name").alias("v_name"), F.col("emb").alias("v_emb"))
    kinds = dict(unnamed.dtypes)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        at, who, s = [np.zeros(0, np.int64)], [], [np.zeros(0)]
        if len(a) and len(b):
            matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), -1)
            names = np.array(b.column("v_name").to_pylist(), object)
            order = np.argsort(names, kind="stable")
            first = np.flatnonzero(np.r_[True, names[order][1:] != names[order][:-1]])
            x, y = matrix(a, "emb"), matrix(b, "v_emb")[order].T
            for k in range(0, len(x), STRIP):
                # a person's own voices don't compete with each other; of a block's people only the best two can be the best two of all
                best = np.maximum.reduceat(x[k : k + STRIP] @ y, first, axis=1)
                rank = np.argsort(-np.where(np.isnan(best), np.inf, best), axis=1, kind="stable")[:, :2]
                at.append(k + np.repeat(np.arange(len(best)), rank.shape[1]))
                who += names[order][first][rank.ravel()].tolist()
                s.append(np.take_along_axis(best, rank, 1).ravel())
        at = pa.array(np.concatenate(at))
        return pa.table([a.column("ep").take(at), a.column("label").take(at), pa.array(who, pa.string()), pa.array(np.concatenate(s), pa.float64())], names=["ep", "label", "into", "sim"])

    met = left.groupBy("ep", "dim", "i", "j").cogroup(right.groupBy("v_ep", "v_dim", "v_i", "v_j")).applyInArrow(meet, f"ep {kinds['ep']}, label {kinds['label']}, into string, sim double")
    j = met.groupBy("ep", "label", "into").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("ep", "label").orderBy(F.desc("sim"), "into")
    r = j.withColumns({"rank": F.row_number().over(w), "next": F.lead("sim").over(w)})
    return r.where((F.col("rank") == 1) & (F.col("sim") >= least) & (F.coalesce(F.col("sim") - F.col("next"), F.lit(1.0)) >= lead)).select("ep", "label", "into", "sim")


#: Seconds of speech that a voice needs to be matched at all, and to be a guest.
MATCHED, GUEST = 15, 60


def guess_guests(voices: DataFrame, candidates: DataFrame, least: float = GUEST) -> DataFrame:
    """(ep, label, name, source): voices without a name (of all voices: ep, label, sec, name, source) by talk time meet candidates by score.

    A voice needs ``least`` seconds. Candidates whose name a voice of the episode has already are out. "sure" where one of each is left
    and every other voice of ``least`` seconds has its name from a voiceprint. Equal scores go by rank, where candidates have one, then name.
    """
    ep = Window.partitionBy("ep")
    has = F.coalesce("name", F.lit("")) != ""
    long = voices.where(F.col("sec") >= least)
    v = long.withColumn("known", F.bool_and(~has | (F.coalesce("source", F.lit("")) == "voiceprint")).over(ep)).where(~has)
    v = v.withColumns({"rank": F.row_number().over(ep.orderBy(F.desc("sec"), "label")), "n": F.count(F.lit(1)).over(ep)}).drop("name", "source")
    c = candidates.join(voices.where(has).select("ep", "name"), ["ep", "name"], "left_anti")
    order = [F.desc("score"), *(["rank"] if "rank" in candidates.columns else []), "name"]
    c = c.withColumns({"rank": F.row_number().over(ep.orderBy(*order)), "m": F.count(F.lit(1)).over(ep)})
    return v.join(c, ["ep", "rank"]).select("ep", "label", "name", F.when((F.col("n") == 1) & (F.col("m") == 1) & F.col("known"), "sure").otherwise("guess").alias("source"))


def _with(voices: DataFrame, new: DataFrame) -> DataFrame:
    """voices with name and source of new (ep, label, name, source) where it has any."""
    n = new.select("ep", "label", F.col("name").alias("_name"), F.col("source").alias("_source"))
    return voices.join(n, ["ep", "label"], "left").withColumns({"name": F.coalesce("_name", "name"), "source": F.coalesce("_source", "source")}).drop("_name", "_source")


def redo_guests(voices: DataFrame, candidates: DataFrame, least: float = GUEST) -> DataFrame:
    """All voices with guesses made anew: what was guessed is forgotten, names from voiceprints and by hand stay."""
    guessed = F.coalesce("source", F.lit("")).isin("guess", "sure")
    bare = voices.withColumns({"name": F.when(guessed, None).otherwise(F.col("name")), "source": F.when(guessed, None).otherwise(F.col("source"))})
    return _with(bare, guess_guests(bare, candidates, least))


def name_voices(windows: DataFrame, profiles: DataFrame, speech: DataFrame, regulars: DataFrame, candidates: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(ep, label, sec, name, source, score, margin) of all voices of the episodes that aren't done yet.

    windows (ep, label, win, emb), profiles (name, emb), speech (ep, label, sec), regulars (ep, name): those of the episode's show. A voice of
    ``MATCHED`` seconds and three windows gets the best name at 0.55 (0.63 for one who isn't a regular) and a lead of 0.05; then regulars not
    found yet their second chance; then voices that are a part of a named one that name; then, in episodes all of whose regulars are enrolled, guests theirs.
    """
    if done is not None:
        windows, speech = (x.join(done.select("ep"), "ep", "left_anti") for x in (windows, speech))
    enough = speech.where(F.col("sec") >= MATCHED).select("ep", "label")
    heard = windows.join(enough, ["ep", "label"], "left_semi")
    heard = heard.join(heard.groupBy("ep", "label").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").select("ep", "label"), ["ep", "label"], "left_semi")
    best = best_names(window_scores(heard, profiles)).join(regulars.select("ep", "name", F.lit(True).alias("regular")), ["ep", "name"], "left").withColumn("regular", F.coalesce("regular", F.lit(False)))
    v = speech.join(best.withColumnRenamed("name", "best"), ["ep", "label"], "left")
    good = (F.col("score") >= F.when(F.col("regular"), 0.55).otherwise(0.63)) & (F.col("margin") >= 0.05)
    v = v.withColumns({"name": F.when(good, F.col("best")), "source": F.when(good, "voiceprint")})
    found = v.where("name is not null").select("ep", "name")
    again = second_chance(v.where("name is null and regular").drop("name").withColumnRenamed("best", "name"), None, found)
    v = _with(v, again.select("ep", "label", "name", F.lit("voiceprint").alias("source")))
    middle = centroids(heard.select(F.struct("ep", "label").alias("voice"), "emb"), "voice").select("voice.ep", "voice.label", "emb")
    named = v.where("name is not null").select("ep", "label", "name").join(middle, ["ep", "label"])
    parts = fold(v.where("name is null").select("ep", "label").join(middle, ["ep", "label"]), named)
    v = _with(v, parts.select("ep", "label", F.col("into").alias("name"), F.lit("voiceprint").alias("source")))
    missing = regulars.join(profiles.select("name").distinct(), "name", "left_anti").select("ep").distinct()
    guests = guess_guests(v.join(missing, "ep", "left_anti"), candidates)
    return _with(v, guests).select("ep", "label", "sec", "name", "source", "score", "margin")


def sample_windows(turns: DataFrame, trim: float = 0.3, size: float = 4.0, least: float = 2.0, most: int = 24) -> DataFrame:
    """(ep, label, win, start, end): windows of a label's turns, ``most`` spread evenly where there are more."""
    t = turns.withColumns({"a": F.col("start") + trim, "b": F.col("end") - trim}).where(F.col("b") - F.col("a") >= least)
    n = F.floor((F.col("b") - F.col("a") - least) / size)
    w = t.select("ep", "label", "a", "b", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("k"))
    w = w.select("ep", "label", (F.col("a") + F.col("k") * size).alias("start"), F.least(F.col("a") + (F.col("k") + 1) * size, F.col("b")).alias("end"))
    line = Window.partitionBy("ep", "label").orderBy("start")
    w = w.withColumns({"i": F.row_number().over(line) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("ep", "label"))})
    # window i is the k-th of `most` even steps for some k
    k = F.round(F.col("i") * (most - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    near = F.exists(F.array(k - 1, k, k + 1), lambda x: (x >= 0) & (x < most) & (F.bround(x * (F.col("n") - 1) / (most - 1)) == F.col("i")))
    w = w.where((F.col("n") <= most) | near)
    return w.select("ep", "label", (F.row_number().over(line) - 1).alias("win"), "start", "end")
