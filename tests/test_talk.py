from palaver.operators import lines, talk

ROWS = [  # the second episode has nobody with 30 seconds, the third no person at all
    ("a", 1, 0, "Ann", 60, 9, "s", "2020-01-01"), ("a", 2, 20, "Ann", 60, 9, "s", "2020-01-01"), ("a", 3, 40, "Bob", 3, 9, "s", "2020-01-01"),
    ("b", 4, 0, "Ann", 15, 9, "s", "2020-02-01"), ("b", 5, 10, "Bob", 3, 9, "s", "2020-02-01"),
    ("c", 6, 7, "", 3, 9, "s", "2021-01-01"),
]
SCHEMA = "ep string, id long, t long, spk string, words long, chars long, series string, date string"


def test_short_appearances_and_silent_episodes_count(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r["year"], r["spk"]): round(r["hours"] * 3600) for r in talk.hours(df, ("Ann",)).collect()}
    assert got == {("2020", "Ann"): 50, ("2020", None): 42 + 12, ("2021", None): 9}
    timed = lines.durations(df)
    row = talk.summary(lines.talk(df), lines.lengths(timed), ("Ann",)).first()
    assert (row["episodes"], row["median_len"], row["most_talk"]) == (3, 12.0, "Ann")
    assert round(row["host_share"], 4) == round(40 / 42 / 3, 4)


def test_no_lines(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert talk.hours(df, ("Ann",)).count() == 0
    assert talk.summary(lines.talk(df), lines.lengths(lines.durations(df)), ("Ann",)).first()["episodes"] == 0
