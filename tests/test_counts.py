from pyspark.sql import functions as F

from palaver.functions.text import word_pattern
from palaver.operators import facts, style, talk


def test_words_are_counted_behind_the_shuffle(spark):
    """A group's words never meet in a hash table of all of a task's groups: no aggregation by word, and null keys, null texts and several rows a group count."""
    x = spark.createDataFrame([(1, "a", "2020", "It's it's  one"), (1, "a", "2020", "One's one one one"), (2, None, "2021", "one"), (3, "b", "2021", None)], "ep int, person string, year string, text string")
    c = style.token_counts(x)
    assert "Aggregate" not in c._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.ep, r.person or "", r.word, r.n, r.capped) for r in c.collect()) == [(1, "a", "it's", 2, 2), (1, "a", "one", 4, 3), (1, "a", "one's", 1, 1), (2, "", "one", 1, 1)]


def test_year_words_read_counts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(i):
        read.add(1)
        return i

    rows = [(i, "s", str(2020 + i % 2), w, 2 + i % 3, 2) for i in range(40) for w in (("one", "two") if i % 4 else ("one", "three"))]
    c = spark.createDataFrame(rows, "ep int, person string, year string, word string, n long, capped long").withColumn("year", seen("year"))
    style.year_words(c, least=2, episodes=2).collect()
    assert read.value == len(rows)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_are_counted_before_windows(spark):
    """Windows of headlines deal out numbers, not texts: nodes are printed from the result down to the scan."""
    x = spark.createDataFrame([(1, 1, 0, "ann", "s", "2020-01-01", "Main", 2, 6, "the la")], "ep int, id long, t long, spk string, series string, date string, kind string, words long, chars long, text string")
    s = talk.spoken(x, ("the",), ("la",), ("la", "the la"), ())
    plan = _plan(s)
    assert plan.index("regexp_extract_all(") > plan.rindex("Window [")
    assert [(r.swears, r["items"], r.phrases, r.hit.t) for r in s.collect()] == [(1, 0, [1, 1], 0)]


def test_facts_read_their_lines_once(spark):
    x = spark.createDataFrame([(1, 1, 0, "ann", "the fact of it is that all is well here. "), (1, 2, 5, "bob", "Of course it is, as everybody knows.")], "ep int, id long, t long, spk string, said string")
    x = x.select("ep", "id", "t", "spk", F.concat("said", F.lit("MARK.")).alias("text"))
    f = facts.extract(x, facts.Rules(r"(?i)\bthe\b", r"(?i)\bof\b", {"Ann": ["and"]}, apart=1))
    assert "MARK" not in _plan(f)
    assert f.count() > 0


def test_first_letters_match_in_any_case(spark):
    words = ["kilo", "is", "été", "#tag", "^up", "-x", "]y", "&&z", "so so"]
    x = spark.createDataFrame([(t,) for t in ("Kilo ſo-SO İs is", "ÉTÉ, #TAG ^Up -X ]Y &&Z", "kiloS xis")], "x string")
    p = word_pattern(words)
    plain = p.replace(p[p.index("(?=") : p.index("(?<!")], "", 1)
    assert plain != p
    assert [r.a for r in x.select(F.regexp_extract_all("x", F.lit(p), F.lit(0)).alias("a")).collect()] == [r.a for r in x.select(F.regexp_extract_all("x", F.lit(plain), F.lit(0)).alias("a")).collect()]
