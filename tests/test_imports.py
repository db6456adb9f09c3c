import pytest
from pyspark.sql import functions as F

from palaver.operators import shows, topics
from palaver.sources import captions


def test_imported_files(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\nAnn: one\n\n2\n00:00:02,500 --> 00:00:03,000\nof nobody\n\n3\n00:00:04,000 --> 00:00:05,000\n[Speaker 7] two\n\n4\n00:00:06,000 --> 00:00:07,000\n<v Bo>three</v>"
    d = spark.createDataFrame([("/in/2020-01-02 #1 A.srt", srt), ("/in/no date.vtt", srt), ("2021-01-01.vtt", "WEBVTT\n\n00:01.000 --> 00:02.000\nalone\n"), ("/in/2022-02-02 x.vtt", None)], "path string, content string")
    texts, names, out = captions.imported(d)
    got = {r.ep: r.content for r in texts.collect()}
    assert got["2020-01-02 #1 A"].split("\n\n")[1:] == ["00:00:01.000 --> 00:00:02.000\n[Speaker 1] one", "00:00:02.500 --> 00:00:03.000\n[Speaker 1] of nobody", "00:00:04.000 --> 00:00:05.000\n[Speaker 2] two", "00:00:06.000 --> 00:00:07.000\n[Speaker 3] three\n"]
    assert "alone" in got["2021-01-01"] and "[" not in got["2021-01-01"] and len(got) == 2
    assert sorted(tuple(r) for r in names.collect()) == [("2020-01-02 #1 A", "Speaker 1", "Ann"), ("2020-01-02 #1 A", "Speaker 3", "Bo")]
    assert [r.path for r in out.collect()] == ["/in/no date.vtt"]


def test_run_and_references(spark):
    d = spark.createDataFrame([("a", 1, "Main", "T", "5", "2020-01-02"), ("b", 2, "Main", None, "", None), ("a", 3, "Bonus", "U", None, "2020")], "series string, ep long, kind string, title string, number string, date string")
    ids = lambda x: sorted(r.ep for r in x.collect())
    assert ids(shows.Run().rows(d)) == [1, 2, 3] and ids(shows.Run(["a"]).chief(d)) == [1] and ids(shows.Run(["a"], True).chief(d)) == [1, 3] and ids(shows.Run([]).rows(d)) == []
    made = shows.Run(skip=["y"]).pages({"x": lambda: d, "y": lambda: 1 / 0})
    assert list(made) == ["x"]
    with pytest.raises(ValueError, match="no such pages: z"):
        shows.Run(skip=["z"]).pages({"x": lambda: d})
    got = {r.ep: r.r for r in d.select("ep", shows.reference().alias("r")).collect()}
    assert tuple(got[1]) == ("a", 1, "T", "5", "2020-01-02", "Main") and tuple(got[2]) == ("b", 2, "", None, "", "Main")
    m = topics.medians(d.withColumn("v", F.when(F.col("series") == "a", F.col("ep"))), "series", "v")
    assert sorted(tuple(r) for r in m.collect()) == [("a", 2, 2.0, 2.0), ("b", 0, 0.0, 0.0)]
