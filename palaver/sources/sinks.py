"""Where results go: tables swapped in whole, compacted, or written as one compact JSON document a page."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "path STRING, seg BIGINT, pos BIGINT, word STRING, start DOUBLE, `end` DOUBLE, spk STRING"


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), lambda x: jvm.org.apache.hadoop.fs.Path(x)


def swap(df: DataFrame, path: str) -> None:
    """df in place of the table at path. A write that fails leaves the old rows, and so does a move that fails: the old table is put back.

    df may read the table that it replaces. Between the two moves there is no table at path for a moment; ``store.Store`` has no such moment.
    """
    fs, at = _fs(df.sparkSession, path)
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        df.write.parquet(new)
        there = fs.exists(at(path))
        if there and not fs.rename(at(path), at(old)):
            raise RuntimeError(f"{path} could not be moved away")
        if not fs.rename(at(new), at(path)):
            if there and not fs.rename(at(old), at(path)):
                raise RuntimeError(f"{path} could not be replaced, nor put back: its rows are at {old}")
            raise RuntimeError(f"{path} could not be replaced")
    except Exception:
        fs.delete(at(new), True)
        raise
    fs.delete(at(old), True)


def compact(spark: SparkSession, path: str, files: int) -> None:
    """The table at path in so many files: worth it after many rows have gone."""
    swap(spark.read.parquet(path).repartition(files), path)


def page_document(df: DataFrame, built: Column) -> DataFrame:
    """(json): one document of a page's rows in their columns' order, with the time it was built. For pages, whose rows are few by nature."""
    rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
    return df.agg(F.to_json(F.struct(F.date_format(built, "yyyy-MM-dd").alias("built"), rows.alias("rows"))).alias("json"))


def write_words(words: DataFrame, path: str) -> None:
    """A recogniser's words as gzipped JSON, a file a partition; what is there already is replaced."""
    words.write.mode("overwrite").json(path, compression="gzip")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words that ``write_words`` has kept; the schema is fixed, so nothing is read twice."""
    return spark.read.schema(WORDS).json(path)


def optional(spark: SparkSession, path: str, schema: str, required: bool = False) -> DataFrame:
    """A JSON table that may be missing: no rows then, or an error where it is required."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def note_failures(failed: DataFrame, path: str) -> None:
    """A row for each try that failed, put behind those noted before; ``shows.worth_a_try`` reads them."""
    failed.write.mode("append").parquet(path)
