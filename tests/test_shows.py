import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions import names
from palaver.functions import text as fx
from palaver.operators import pages, shows, voices
from palaver.sources import sinks


def one(spark, x):
    return spark.range(1).select(x.alias("x")).first().x


def test_names_by_the_rules(spark):
    want = {
        "2023-01-26 - 463. Title": ("463", "Title"), "2021-05-14 - 373 Title": ("373", "Title"), "2020-01-02 12th Night": ("", "12th Night"), "2023-05-17 #1 Title": ("1", "Title"),
        "2008-10-11 1 #001 Title": ("1", "#001 Title"), "2020-01-02 7.5 Half": ("7.5", "Half"), "2020-01-02 99": ("99", "99"), "No date 12": ("", "No date 12"), "": ("", ""),
    }
    d = spark.createDataFrame([(n,) for n in want], "n string").select("n", names.number(F.col("n")), names.title(F.col("n")), names.label(F.col("n")))
    got = {r[0]: r[1:] for r in d.collect()}
    assert {n: g[:2] for n, g in got.items()} == want
    assert got["2023-01-26 - 463. Title"][2] == "#463 Title" and got["No date 12"][2] == "No date 12"
    assert one(spark, names.kind(F.lit("2020-01-02 - Special day"), [("(?i)^special", "Special")])) == "Special"
    assert one(spark, F.round(names.year_fraction(F.lit("2020-07-02")), 4)) == 2020.5027 and one(spark, names.year_fraction(F.lit(""))) is None


def test_small_rules(spark):
    assert one(spark, fx.search_terms(F.array(*map(F.lit, ["Bigfoot", "bigfoots", "the yeti", "yeti", "YETI"])))) == 'bigfoot | "the yeti" | yeti'
    assert [one(spark, fx.voice_label(F.lit(x))) for x in ("SPEAKER_00", "", None, "S12")] == ["[Speaker 1] ", "", "", "[Speaker 13] "]
    assert one(spark, fx.half_even(F.lit(2.5))) == 2.0 and one(spark, fx.loudness(F.array(F.lit(3.0), F.lit(-4.0)))) == pytest.approx(12.5**0.5)
    assert one(spark, fx.loudness(F.array().cast("array<double>"))) == 0.0
    people = {"Ann": ["Ann", "Anna"], "Bob": ["Bob"]}
    assert [one(spark, fx.last_named(F.lit(x), people)) for x in ("Bob and Ann", "Ann then Bob", "Annabel", "")] == ["Ann", "Bob", "", ""]
    assert one(spark, fx.announced(F.lit("and that is me"), F.lit("Bob"), people, r"\bis me\b")) == "Bob"
    hand = lambda line, d: one(spark, fx.handed_to(F.lit(line), F.lit(d), people, r"\b(?:is|to) ([A-Z]\w+)", ("Okay",), {"Zed": "Zed Young"}))
    assert hand("that is Russell", "With Russell T Davies, live") == "Russell T Davies" and hand("over to Zed", None) == "Zed Young" and hand("over to Ned", "Ned, Zed") == "Ned" and hand("it is Okay", "") == "" and hand("it is Ann", "Ann B") == ""
    full = lambda d, first: one(spark, fx.name_in_full(F.lit(d), F.lit(first)))
    assert [full(*x) for x in (("with (Mary de la Cruz)", "Mary"), ("Maryland, Mary van Dyke's", "Mary"), ("Mary, Queen", "Mary"), ("St. Mary T. Roach. Then", "Mary"), ("Mary desk", "Mary"), ("none", "Mary"), (None, "Mary"), ("x", ""))] == ["Mary de", "Mary van Dyke's", "Mary", "Mary T. Roach. Then", "Mary", "", "", ""]
    m = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert one(spark, fx.cache_key(F.lit(7), m[0])) == one(spark, fx.cache_key(F.lit(7), m[1])) != one(spark, fx.cache_key(F.lit(8), m[1]))
    assert one(spark, fx.highlight(F.lit("The cat, bathe"), ["the"])) == "<mark>The</mark> cat, bathe"
    assert [one(spark, fx.clock(F.lit(x))) for x in (59, 61, 3661)] == ["0:59", "1:01", "1:01:01"]


def test_phrases_across_lines(spark):
    d = spark.createDataFrame([(1, 1, 0, "a friend of"), (1, 2, 1, "the show, Friend of the show"), (1, 3, 2, "friend of the show and friend-of the show"), (2, 1, 0, "the friend of")], "ep long, id long, t long, text string")
    got = sorted(tuple(r) for r in pages.phrases_across_lines(d, r"(?i)\bfriend[\s-]+of\s+the\s+show\b", "(?i)friend").collect())
    assert got == [(1, 1, "friend of the show", True), (1, 2, "friend of the show", False), (1, 3, "friend of the show", False)]


def test_voices_fold_by_person(spark):
    named = spark.createDataFrame([(1, "Ann", [1.0, 0.0]), (1, "Ann", [0.98, 0.199]), (1, "Bob", [0.0, 1.0])], "ep long, name string, emb array<double>")
    new = spark.createDataFrame([(1, "L", [0.99, 0.1411])], "ep long, label string, emb array<double>")
    assert [(r.label, r.into) for r in voices.fold(new, named).collect()] == [("L", "Ann")]
    best = spark.createDataFrame([(1, "x", "Ann", 0.5, 0.2, 300.0), (1, "y", "Ann", 0.6, 0.2, 119.0), (1, "z", "Bob", 0.9, 0.5, 500.0)], "ep long, label string, name string, score double, margin double, sec double")
    assert [r.label for r in voices.second_chance(best, ["Ann", "Bob"], spark.createDataFrame([(1, "Bob")], "ep long, name string")).collect()] == ["x"]


def test_layouts_and_times(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    old = spark.createDataFrame([("1", 2.0), ("x", 3.0)], "a string, gone double")
    assert [tuple(r) for r in shows.conformed(old, schema).collect()] == [(1, None), (None, None)]
    assert shows.needs_backfill(old, schema) and not shows.needs_backfill(shows.conformed(old, schema), schema)
    t = dt.datetime(2020, 1, 1, 12, 0, 5)
    assert one(spark, shows.row_time(F.lit(dt.datetime(2021, 1, 1)), F.lit(t))) == dt.datetime(2020, 1, 1, 12, 0, 4)
    assert [r.description for r in shows.described(spark.createDataFrame([(1,)], "ep long"), None).collect()] == [""]


def test_sinks(spark, tmp_path):
    p = f"{tmp_path}/t"
    sinks.swap(spark.range(10), p)
    sinks.swap(spark.read.parquet(p).where("id < 4"), p)
    assert spark.read.parquet(p).count() == 4
    with pytest.raises(Exception):
        sinks.swap(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), p)
    assert spark.read.parquet(p).count() == 4 and [x.name for x in tmp_path.iterdir() if x.is_dir()] == ["t"]
    sinks.compact(spark, p, 1)
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 1
    w = spark.createDataFrame([("p", 1, 0, "hi", 0.0, 0.5, "a")], sinks.WORDS)
    sinks.write_words(w, f"{tmp_path}/w")
    assert list((tmp_path / "w").glob("*.json.gz")) and sinks.read_words(spark, f"{tmp_path}/w").collect() == w.collect()
    assert sinks.optional(spark, f"{tmp_path}/none.json", "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        sinks.optional(spark, f"{tmp_path}/none.json", "a int", required=True)
    doc = json.loads(sinks.page_document(spark.range(2), F.lit("2020-02-03").cast("timestamp")).first().json)
    assert doc == {"built": "2020-02-03", "rows": [{"id": 0}, {"id": 1}]}
    for _ in range(3):
        sinks.note_failures(spark.createDataFrame([(5,)], "id long"), f"{tmp_path}/f")
    assert sorted(r.id for r in shows.worth_a_try(spark.range(4, 7), spark.read.parquet(f"{tmp_path}/f"), ["id"]).collect()) == [4, 6]
