import pytest
from pyspark.sql import functions as F

from palaver.operators import guests, voices
from palaver.operators.guests import People

KNOWN = People({"Dan": ["dan green"], "Eve": ["eve adams"], "Fay": ["fay low"]}, ("Dan", "Eve", "Al"), {"Fay": (r"\bFay L[oa]w\b", ("fay",))}, ("Museum", "Awards", "Club"))


def found(spark, *episodes, listed_only=None):
    """[(name, score)] of each (title, description, transcript)."""
    e = spark.createDataFrame([(i, t, d) for i, (t, d, _) in enumerate(episodes)], "ep int, title string, description string")
    x = spark.createDataFrame([(i, s) for i, (_, _, s) in enumerate(episodes)], "ep int, text string")
    got = guests.candidates(e, x, KNOWN, listed_only).orderBy("ep", "rank").collect()
    return [[(r.name, r.score) for r in got if r.ep == i] for i in range(len(episodes))]


def test_lists_and_joins(spark):
    got = found(
        spark,
        ("", "Dan, Eve, Al and special guest Mary Stone discuss bees.", "hello"),  # listed: 10 + 5, introduced: 5, though never said
        ("Mary Stone!", "Dan, Eve and Mary Stone of Bee World chat about it", "mary stone mary"),  # + 5 for the title, 3 + 2 + 1 for what is said
        ("", "Novelist and pilot Mary van Stone, Dan and Eve talk", ""),  # the whole part is no name; its last two capitals aren't side by side
        ("", "Live from The Old Hall, Dan, Eve and Show creator Mary Stone are discussing", ""),  # a place; job words before the name
        ("", "Mary Stone of the Bee Company joins Dan and Eve.", "no"),  # 10 + 5
        ("", "Mary Stone returns to join the team", "no"),  # introduced too
        ("", "Bee Museum and Mary Club discuss", "bee museum bee museum"),  # things
        ("", "Dan Eve, Dan Green and Al discuss", "dan green dan green"),  # a list without a comma, an enrolled person
        ("", None, None),
    )
    assert got == [[("Mary Stone", 20)], [("Mary Stone", 26)], [], [("Mary Stone", 15)], [("Mary Stone", 15)], [("Mary Stone", 20)], [], [], []]


def test_introductions_need_to_be_heard(spark):
    text = "We are joined by author and walker Mary Stone. Also Zed Young, welcome Dr Bo Lind OBE!"
    said = "mary stone says so. stone. bo lind bo lind. " * 2
    episodes = [("", text, said), ("", text, "nothing of the kind"), ("", "Mary Stone is here. Mary Stone was there.", "mary stone " * 9)]
    # 5 + (2 x 3 + 4 + 2); 5 + (4 x 3 + 4 + 4 = 20); 2 x 5 + 20 at most
    assert found(spark, *episodes) == [[("Bo Lind", 25), ("Mary Stone", 17)], [], [("Mary Stone", 30)]]
    assert found(spark, *episodes, listed_only=F.lit(True)) == [[], [], []]


def test_aliases_shorter_names_and_ties(spark):
    got = found(
        spark,
        ("", "With Fay Law. And more", "fay fay fay"),  # 15 + 3
        ("", "Fay Low joins Dan", "fay"),  # said once; the full name isn't a candidate of its own
        ("", "Reading John Higgs and John Higgs discuss", ""),
        ("", "Zoe Young, Bo Lind and Ann Low discuss", ""),
        ("", "Zoe Young and Zoe Young discuss", "zoe"),
    )
    assert got == [[("Fay", 18)], [], [("John Higgs", 15)], [("Zoe Young", 20), ("Bo Lind", 15), ("Ann Low", 15)], [("Zoe Young", 26)]]


def test_guests_by_hand_come_first(spark):
    f = spark.createDataFrame([(1, "A B", 20, 1), (2, "C D", 30, 1)], "ep long, name string, score int, rank int")
    hand = spark.createDataFrame([(1, "Z", 1), (1, "Y", 2)], "ep long, name string, place int")
    assert sorted(tuple(r) for r in guests.with_hand(f, hand).collect()) == [(1, "Y", 100, 2), (1, "Z", 100, 1), (2, "C D", 30, 1)]


V = "ep long, label string, sec double, name string, source string"


def test_names_that_are_taken_and_short_voices(spark):
    rows = [(1, "L1", 90.0, "Ann", "voiceprint"), (1, "L2", 80.0, None, None), (1, "L3", 10.0, None, None), (2, "L1", 90.0, None, None), (2, "L2", 70.0, None, ""), (3, "L1", 99.0, "Ann", "hand"), (3, "L2", 61.0, None, None), (4, "L1", 59.0, None, None)]
    c = spark.createDataFrame([(e, n, s) for e in (1, 2, 3, 4) for n, s in (("Ann", 50), ("Bob", 40))], "ep long, name string, score int")
    got = sorted(tuple(r) for r in voices.guess_guests(spark.createDataFrame(rows, V), c).collect())
    # Ann is matched by voice in 1, so the open voice is Bob; a voice of ten seconds is nobody's, and doesn't stand in the way of "sure"
    assert got == [(1, "L2", "Bob", "sure"), (2, "L1", "Ann", "guess"), (2, "L2", "Bob", "guess"), (3, "L2", "Bob", "guess")]


@pytest.fixture(scope="module")
def studio(spark):
    """Three people's profiles, and voices at given angles to them."""
    p = {"Ann": [1.0, 0.0, 0.0], "Bob": [0.0, 1.0, 0.0], "Cy": [0.0, 0.0, 1.0]}
    near = lambda who, s: [s * a + (1 - s * s) ** 0.5 * (0.0 if a else 0.0) for a in p[who]]
    v = {(1, "A"): near("Ann", 0.9), (1, "B"): near("Bob", 0.5), (1, "C"): near("Cy", 0.6), (1, "D"): [0.0, 0.0, 0.01], (2, "A"): near("Ann", 0.9), (2, "G"): [0.01, 0.0, 0.0], (3, "X"): near("Ann", 0.9)}
    w = [(e, label, k, x) for (e, label), x in v.items() for k in range(3)] + [(1, "short", 0, p["Ann"]), (2, "few", 0, p["Bob"]), (2, "few", 1, p["Bob"])]
    speech = [(e, label, 200.0) for e, label in v] + [(1, "short", 5.0), (2, "few", 50.0)]
    return {
        "windows": spark.createDataFrame(w, "ep long, label string, win int, emb array<double>"), "profiles": spark.createDataFrame(list(p.items()), "name string, emb array<double>"),
        "speech": spark.createDataFrame(speech, "ep long, label string, sec double"), "regulars": spark.createDataFrame([(1, "Ann"), (1, "Bob"), (2, "Ann"), (3, "Ann"), (3, "Nobody")], "ep long, name string"),
        "candidates": spark.createDataFrame([(e, n, s) for e in (1, 2, 3) for n, s in (("Ann", 30), ("Gus", 20))], "ep long, name string, score int"),
    }


def test_the_whole_naming(studio, spark):
    got = {(r.ep, r.label): (r.name, r.source) for r in voices.name_voices(**studio).collect()}
    assert got[1, "A"] == got[2, "A"] == got[3, "X"] == ("Ann", "voiceprint")
    assert got[1, "B"] == ("Bob", "voiceprint")  # 0.5: a regular's second chance
    assert got[1, "C"][0] == "Gus"  # 0.6 is too little for one who isn't a regular: left for the guest
    assert got[1, "short"] == (None, None) and got[2, "few"] == (None, None)
    assert got[2, "G"] == ("Ann", "voiceprint")  # weak, but it points the way the episode's Ann does: a part of her voice
    assert len(got) == 9
    # a show whose regulars aren't all enrolled gets no guests; done episodes aren't looked at
    assert {r.ep for r in voices.name_voices(**studio, done=spark.createDataFrame([(1,), (3,)], "ep long")).collect()} == {2}


def test_a_description_is_worked_out_once(spark):
    """A description that costs something isn't worked out again for every place that reads it, however many patterns there are."""
    e = spark.createDataFrame([(1, "a", "b")], "ep int, title string, text string").select("ep", "title", F.concat("text", F.lit("MARK")).alias("description"))
    c = guests.candidates(e, spark.createDataFrame([(1, "x")], "ep int, text string"), guests.People())
    assert c._jdf.queryExecution().optimizedPlan().toString().count("MARK") <= 2
