from pyspark.sql import functions as F

from palaver.streaming import ingest


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return q


def test_caption_stream(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\n[x] one\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n00:03.000 --> 00:04.000\ntwo\n")
    run(ingest.caption_stream(spark, str(tmp_path)), "cues")
    assert sorted((r.start, r.label, r.text) for r in spark.table("cues").collect()) == [(1.0, "x", "one"), (3.0, "", "two")]


def test_minute_counts(spark, tmp_path):
    rows = [("1.1.1.1", f"2024-01-01 00:00:{s:02d}") for s in range(40)] + [("2.2.2.2", "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "ip string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ip string, ts timestamp").parquet(str(tmp_path / "in"))
    run(ingest.minute_counts(s), "minutes", "complete")
    assert sorted((r.ip, r.n, r.allowed) for r in spark.table("minutes").collect()) == [("1.1.1.1", 40, False), ("2.2.2.2", 1, True)]


def test_upsert_sink(spark, tmp_path):
    at, seen = str(tmp_path / "t"), {}
    f = ingest.upsert_sink(lambda: seen.get("df"), lambda df: seen.update(df=spark.createDataFrame(df.collect(), df.schema)), ["k"])
    schema = "k int, v string"
    f(spark.createDataFrame([(1, "a"), (2, "b")], schema), 0)
    f(spark.createDataFrame([(2, "c"), (3, "d")], schema), 1)
    assert sorted(tuple(r) for r in seen["df"].collect()) == [(1, "a"), (2, "c"), (3, "d")] and at
