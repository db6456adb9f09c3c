"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / weight, u a hash of its id, so that sorting a source by
key draws its documents without replacement in proportion to their weights. A source's target is first
met by complete epochs over all its documents; what is left of it is filled by the documents of least
key, up to the one at which the running sum of sizes comes nearest to the budget.

Nothing sorts a whole source: keys are cut into ``bins`` equal shares of probability, bin totals
say in which bin the budget ends, and only that bin's documents are sorted and summed. Documents meet
their source's figures by source and salt, so a source with a third of all rows is dealt over ``SALTS`` tasks.

Cases: null text has size 0; null source is a source of its own, last; null or repeated ids are
kept, each row by itself (rows alike in id and size are exchangeable); empty table, empty result;
documents of size 0 are taken with their epochs or share but count no words; extra columns stay if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.common import WORD, checkpoint, table

SALTS = 64
SHARES = (5.0, 2.0, 1.0)
#: Weight in the draw by labels.quality: good, unknown, poor.
QUALITY = (2.0, 1.0, 0.5)
_UNIT = float(1 << 52)


def targets(sizes: DataFrame, shares: Sequence[float] = SHARES, total: float = 1.5, most: float = 2.0, rounds: int = 64) -> DataFrame:
    """(source, source_size) with the words that each source is to give.

    The k-th source by code point (null last) weighs shares[k mod len(shares)]; together they give ``total`` times
    all sizes, none over ``most`` times its own, the excess reshared by weight. ``sizes`` has one row a source:
    it is the recipe, a dimension table, and the only thing here that is ordered as a whole.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*[F.lit(float(x)) for x in shares]), (F.row_number().over(order) - 1) % len(shares) + 1)
    s = sizes.withColumn("share", share).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # Filled in order of cap / share: sources before the first that isn't full are at their cap, the rest share what is left.
    fill = Window.orderBy((F.col("cap") / F.col("share")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("budget", F.lit(float(total)) * F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("share").over(after))
    s = s.withColumn("open", F.col("level") * F.col("share") < F.col("cap"))
    s = s.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("share"), "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("share")), "cap").alias("target"))


def unit(id_: Column, seed: str) -> Column:
    """A number inside (0, 1) from the id: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / _UNIT


def mix(docs: DataFrame, size: Column | None = None, weight: Column | None = None, seed: str = "mix", bins: int = 1024, id_col: str = "doc_id", source_col: str = "source", keep: Sequence[str] = (), **recipe) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies (how often the mix takes it), taken, and ``keep``.

    ``size`` is the words of column text unless given; ``weight`` is 1 unless given, and must be above 0.
    """
    size = F.regexp_count(F.col("text"), F.lit(WORD)) if size is None else size
    key = -F.log(unit(F.col(id_col), seed)) / (F.lit(1.0) if weight is None else weight)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    # 1 - exp(-key) is even over (0, 1) for weight 1, and finer at the front for heavier documents.
    d = d.withColumn("bin", F.least(F.lit(bins - 1), F.floor((1 - F.exp(-F.col("key"))) * bins)).cast("int"))
    d = d.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    d = checkpoint(d)  # texts are read once; what follows is a few numbers a document
    per_bin = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(per_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), **recipe)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # The bin in which each source's rest ends: bins of a source are at most `bins` rows.
    upto = Window.partitionBy("source").orderBy("bin")
    ends = (
        per_bin.withColumn("upto", F.sum("bin_size").over(upto))
        .alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
        .where(F.col("upto") > F.col("rest"))
        .groupBy(F.col("g.source").alias("source"))
        .agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("end"))
    )
    goal = (
        goal.alias("g").join(ends.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left")
        .select("g.*", F.coalesce("e.end.bin", F.lit(bins)).alias("end_bin"), F.coalesce("e.end.before", F.lit(0)).alias("before"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    j = d.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d.salt") == F.col("g.salt"))).select("d.*", "source_size", "target", "epochs", "rest", "end_bin", "before")
    # Only a bin in which a budget ends needs its order.
    at_end = F.col("bin") == F.col("end_bin")
    line = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    last = j.where(at_end).withColumn("upto", F.col("before") + F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    half = F.col("upto") - F.col("size") / 2.0
    last = last.withColumn("more", (half <= F.col("rest")).cast("long")).drop("upto")
    rest = j.where(~at_end).withColumn("more", (F.col("bin") < F.col("end_bin")).cast("long"))
    out = rest.unionByName(last).withColumn("copies", F.col("epochs") + F.col("more"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def with_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with mix_weight, the draw's weight by labels.quality (best of repeated labels; unknown where there is none)."""
    q = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("quality").alias("_quality"))
    good, unknown, poor = map(F.lit, QUALITY)
    j = docs.join(q, F.col(id_col) == F.col("_label_id"), "left")
    return j.withColumn("mix_weight", F.when(F.col("_quality") >= 1, good).when(F.col("_quality") <= 0, poor).otherwise(unknown)).drop("_label_id", "_quality")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Words are counted before the labels join, so no text is shuffled.
    slim = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("n"))
    docs = with_quality(slim, table(spark, sf_dir, "labels"))
    return mix(docs, size=F.col("n"), weight=F.col("mix_weight")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE_SQL = """
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496)
      / (CASE WHEN q.quality >= 1 THEN 2.0::DOUBLE WHEN q.quality <= 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS key
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS share
  FROM d GROUP BY source),
f AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(share) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / share, source ASC NULLS LAST)),
t AS (
  SELECT source, source_size,
    coalesce(least(cap, share * (SELECT arg_min(level, cap / share) FROM f WHERE level * share < cap)), cap) AS target FROM f),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE
      <= e.target - e.epochs * e.source_size OR e.source_size = 0 AS more
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs + CAST(more AS BIGINT)) * size AS taken, epochs + CAST(more AS BIGINT) AS copies FROM r
"""
