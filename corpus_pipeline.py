"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, secrets are blanked, sources are mixed to
their weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one (doc_id, source, n_tokens, ids). Stages call the
operators of palaver.llm over everything that the stage before kept; ``run`` writes each stage's rows to the shared folder and reads them
again, so that a lost executor costs one stage at most. A null id is no group's, so such rows pass the second stage; rows that
repeat an id share its fate. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import bpe, jaccard, mixing, secrets, toxicity
from palaver.llm.common import WORD, checkpoint, discard, if_small, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model, out="_toxic").where("_toxic < 0.5").drop("_toxic")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked documents."""
    groups = jaccard.join(docs)
    gone = checkpoint(groups.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(if_small(gone), F.col("doc_id") == F.col("_gone"), "left_anti")


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    slim = docs.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("n"))
    weighed = mixing.with_quality(slim, table(spark, sf_dir, "labels"))
    taken = mixing.mix(weighed, size=F.col("n"), weight=F.col("mix_weight")).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    taken = checkpoint(taken.where("_copies > 0"))
    j = docs.join(if_small(taken), F.col("doc_id").eqNullSafe(F.col("_id")))
    return j.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_id", "_copies", "_copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, in blocks small enough for executors that have four stages behind them."""
    return bpe.encode(docs, bpe.tokenizer_path(), keep=("doc_id", "source"), outputs=("n_tokens", "ids"), block_chars=6_000_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("secret_scan", blank_secrets),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]
#: SQL can't express the classifier, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
