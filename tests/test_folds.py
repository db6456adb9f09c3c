import random
import re

from pyspark.sql import functions as F

from palaver.functions import names, stem, text
from palaver.operators import edits, folds, joins, lines, topics, voices, words
from palaver.sources import captions


def col(spark, values, f):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in d.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_word_patterns(spark):
    p = text.word_pattern(["wow", "well done", "été"])
    n = col(spark, ["wow wow-wow", "wow's éwow wowé", "well-done Well  DONE", "ÉTÉ", "", None], lambda x: F.regexp_count(x, F.lit(p)))
    assert n == [3, 0, 2, 1, 0, None]
    q = text.word_pattern(["ann"], possessive=True)
    assert col(spark, ["Ann's ann ANN’s annie"], lambda x: F.regexp_count(x, F.lit(q))) == [3]


def test_tokens_and_times(spark):
    assert col(spark, ["Don 't stop, it’s café", None], text.tokens) == [["don't", "stop", "it's", "caf"], []]
    assert col(spark, ["1:02:03.5", "02:03,25", "7"], text.seconds) == [3723.5, 123.25, 7.0]
    assert col(spark, ["Guest 1", "unknown", "Ann", "", None, "guesthouse"], text.is_person) == [False, False, True, False, False, True]


def test_names(spark):
    n = ["2020-01-02 #12 The title", "2020-01-02 12.5", "Bare", "2020-01-02 Only words"]
    assert col(spark, n, names.date) == ["2020-01-02", "2020-01-02", "", "2020-01-02"]
    assert col(spark, n, names.number) == ["12", "12.5", "", ""]
    assert col(spark, n, names.title) == ["The title", "12.5", "Bare", "Only words"]


def test_stems():
    for w, s in dict(caresses="caress", ponies="poni", cats="cat", agreed="agre", plastered="plaster", motoring="motor", hopping="hop", falling="fall", filing="file", happy="happi", sky="sky", relational="relat", conditional="condit", digitizer="digit", hopefulness="hope", formaliti="formal", triplicate="triplic", electrical="electr", revival="reviv", adoption="adopt", probate="probat", rate="rate", controll="control", roll="roll", café="cafe").items():
        assert stem.stem(w) == s, w


def test_captions(spark):
    vtt = "WEBVTT\r\n\r\n00:01.000 --> 00:02.500\r\n[Speaker 1] Hello\r\nthere [noise]\r\n\r\n1:00:03.000 --> 1:00:04.000\nno name\n\n1:00:05,000 --> 1:00:06,000\n<v Ann Lee>Hi</v>\n\n1:00:07.000 --> 1:00:08.000\nBob: yes"
    srt = "1\n00:00:01,000 --> 00:00:02,000\nAnn: one\n\n2\n00:00:02,500 --> 00:00:03,000\n\n3\n00:00:04,000 --> 00:00:05,000\ntwo"
    d = spark.createDataFrame([("a", vtt), ("b", srt), ("c", None), ("d", "WEBVTT")], "path string, content string")
    got = [(r.path, r.start, r.end, r.label, r.text) for r in captions.cues(d).orderBy("path", "pos").collect()]
    assert got == [("a", 1.0, 2.5, "Speaker 1", "Hello there"), ("a", 3603.0, 3604.0, "", "no name"), ("a", 3605.0, 3606.0, "Ann Lee", "Hi"), ("a", 3607.0, 3608.0, "Bob", "yes"), ("b", 1.0, 2.0, "Ann", "one"), ("b", 4.0, 5.0, "", "two")]
    n = captions.named(captions.cues(d)).orderBy("path", "pos").collect()
    assert [(r.label, r.number) for r in n] == [("Speaker 1", 0), ("Speaker 1", 0), ("Ann Lee", 1), ("Bob", 2), ("Ann", 0), ("Ann", 0)]
    again = captions.cues(captions.write(captions.cues(d))).orderBy("path", "pos").collect()
    assert [(r.path, r.start, r.label, r.text) for r in again] == [(p, s, label, t) for p, s, _, label, t in got]
    assert {r.path: r.labelled for r in captions.has_labels(d).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_durations(spark):
    d = spark.createDataFrame([(1, 1, 0, "a", 3, 10), (1, 2, 0, "b", 3, 30), (1, 3, 2, "a", 60, 5), (1, 4, 100, "", 1, 1)], "ep long, id long, t long, spk string, words long, chars long")
    assert {r.id: round(r.dur, 6) for r in lines.durations(d).collect()} == {1: 0.5, 2: 1.5, 3: 20.0, 4: 1.0}
    assert {r.id: round(r.sec, 6) for r in lines.line_seconds(d).collect()} == {1: 1.0, 2: 2.0, 3: 40.0, 4: 5.0}


def test_merge_cues(spark):
    rows = [("a", 0, 0.0, 1.0, "x", "One [hm] two"), ("a", 1, 1.0, 2.0, "x", "three. " + "w" * 60), ("a", 2, 2.0, 3.0, "x", "end."), ("a", 3, 3.0, 4.0, "y", "[noise]"), ("a", 4, 4.0, 5.0, "y", "other"), ("a", 5, 5.0, 6.0, "x", "z" * 320), ("a", 6, 6.0, 7.0, "x", "last")]
    d = spark.createDataFrame(rows, "path string, pos int, start double, end double, label string, text string")
    assert [(r.start, r.end, r.label, len(r.text)) for r in folds.merge_cues(d).orderBy("start").collect()] == [(0.0, 3.0, "x", 80), (4.0, 5.0, "y", 5), (5.0, 6.0, "x", 320), (6.0, 7.0, "x", 4)]


def test_greedy_folds(spark):
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 50, 89, 90, 179, 181])], "ep long, id long, t long")
    assert sorted(r.t for r in folds.keep_apart(d).collect()) == [0, 90, 181]
    assert col(spark, ["no no no no no no, No! yes", "a b a b a b a b a b a b a b end", "five five five five five", None], folds.collapse_loops) == ["no no no yes", "a b a b a b end", "five five five five five", None]
    s = spark.createDataFrame([("a", 0.0, 70.0, "1 2 3 4 5 6 7"), ("a", 80.0, 90.0, "x"), ("a", 100.0, 200.0, "one")], "path string, start double, end double, text string")
    assert [(round(r.start, 2), round(r.end, 2), r.text) for r in folds.split_long(s).orderBy("start").collect()] == [(0.0, 23.33, "1 2"), (23.33, 46.67, "3 4"), (46.67, 70.0, "5 6 7"), (80.0, 90.0, "x"), (100.0, 130.0, "one")]


def test_align_keeps_order_and_pairs_most(spark):
    schema = "ep long, phrase string, id long, t long"
    m = spark.createDataFrame([(1, "p", 1, 10), (1, "p", 2, 25), (1, "q", 3, 0)], schema)
    r = spark.createDataFrame([(1, "p", 7, 28), (1, "p", 8, 40), (1, "q", 9, 21)], schema)
    assert sorted((x.m_id, x.r_id) for x in folds.align(m, r).collect()) == [(1, 7), (2, 8)]


def test_edits(spark):
    base = [(1, 1, 0, "A", "sure", "L0", "hello world"), (1, 2, 5, "B", "sure", "L1", "good bye"), (1, 3, 9, "A", "sure", "L0", "so long"), (1, 4, 50, "A", "sure", "L0", "hello world")]
    d = spark.createDataFrame(base, "ep long, id long, t long, spk string, src string, label string, text string")
    auto = spark.createDataFrame([(1, "L0", "A", "sure"), (1, "L1", "B", "sure")], "ep long, label string, spk string, src string")
    made = spark.createDataFrame([(1, 10)], "ep long, made long")
    log = [(1, 0, "text", 0, "hello world", "", "late", 9), (1, 1, "line_speaker", 9, "so long", "", "Z", 10), (1, 2, "rename", 0, "", "L0", "Ann", 11), (1, 3, "split", 4, "good bye", "", "bye", 12), (1, 4, "join", 1, "hello world", "", "good", 13), (1, 5, "delete", 52, "hello world", "", "", 14), (1, 6, "rename", 0, "", "L1", "", 15), (1, 7, "restore", 60, "gone line", "L1", "Q", 16)]
    e = spark.createDataFrame([(1, i, k, t, o, lb, v, ts) for _, i, k, t, o, lb, v, ts in log], "ep long, id long, kind string, t long, orig string, label string, value string, ts long")
    out = sorted((r.t, r.id, r.spk, r.text) for r in edits.apply_edits(d, e, auto, made).collect())
    assert [(t, s, x) for t, _, s, x in out] == [(0, "Ann", "hello world good"), (5, "B", "bye"), (9, "Z", "so long"), (60, "B", "gone line")]
    assert sorted((r.t, r.id, r.spk, r.text) for r in edits.apply_edits(edits.apply_edits(d, e, auto, made), e, auto, made).collect()) == out


def test_near_joins(spark):
    a = spark.createDataFrame([(1, 1, 100), (1, 2, 500)], "ep long, id long, t long")
    b = spark.createDataFrame([(1, 9, 71), (1, 8, 129), (1, 7, 131), (2, 6, 100)], "ep long, r_id long, r_t long")
    assert [(r.id, r.r_id) for r in joins.nearest(a, b, ["ep"]).collect()] == [(1, 8)]
    assert [(r.id, r.r_id) for r in joins.first_ahead(a, b, ["ep"]).collect()] == [(1, 8)]


def test_guests_and_topics(spark):
    rows = [(1, "L1", 50.0, None, None), (1, "H", 90.0, "Host", "voiceprint"), (2, "L2", 10.0, None, None), (2, "L3", 20.0, "", None), (3, "L4", 5.0, None, None), (3, "H", 9.0, "Host", "hand")]
    v = spark.createDataFrame(rows, "ep long, label string, sec double, name string, source string")
    c = spark.createDataFrame([(1, "Ann", 9.0), (2, "Bob", 5.0), (3, "Cy", 1.0)], "ep long, name string, score double")
    assert sorted(tuple(r) for r in voices.guess_guests(v, c, 0).collect()) == [(1, "L1", "Ann", "sure"), (2, "L3", "Bob", "guess"), (3, "L4", "Cy", "guess")]
    old = v.where("ep = 1").withColumns({"name": F.when(F.col("label") == "L1", "Old").otherwise(F.col("name")), "source": F.when(F.col("label") == "L1", "guess").otherwise(F.col("source"))})
    assert sorted((r.label, r.name, r.source) for r in voices.redo_guests(old, c, 0).collect()) == [("H", "Host", "voiceprint"), ("L1", "Ann", "sure")]
    t = [("Animals", ["cat*", "dog"], 1.0), ("Food", ["fish", "bread"], 2.0)]
    assert col(spark, ["Cats and a dog", "a cat, fish", "cat dog bread", "none"], lambda x: topics.topic(x, t)) == ["Animals", "Food", "Animals", "Other"]
    reads = spark.createDataFrame([(["a", "b"], "friend"), (["a"], "foe")], "who array<string>, verdict string")
    assert sorted(tuple(r) for r in topics.sides(reads).collect()) == [("a", 1, 1, True), ("b", 1, 0, False)]
    d = spark.createDataFrame([(1, 1, 0, "x", "the cat"), (1, 2, 5, "", "The the")], "ep long, id long, t long, spk string, text string")
    assert sorted(tuple(r) for r in words.phrase_counts(d, ["the"]).collect()) == [(1, "?", "the", 2), (1, "x", "the", 1)]


def test_speaker_runs(spark):
    said = [("Well", "a"), ("yes", "b"), ("fine.", "a"), ("No", "b"), ("it", "b"), ("is", "a"), ("not", "a"), ("so", "a")]
    d = spark.createDataFrame([("p", 1, i, w, float(i), i + 0.4, s) for i, (w, s) in enumerate(said)], "path string, seg long, pos int, word string, start double, end double, spk string")
    got = [(r.run, r.start, r.end, r.spk, r.text) for r in folds.speaker_runs(d).orderBy("run").collect()]
    assert got == [(0, 0.0, 7.4, "a", "Well yes fine. No it is not so")]  # both cuts move behind "fine."; both pieces are mostly a's
    thin = [("Oh", "c"), ("this", "a"), ("is.", "a"), ("No", "b"), ("not", "b"), ("at", "c"), ("all", "b"), ("b", "b")]
    d = spark.createDataFrame([("p", 1, i, w, i / 3, i / 3 + 0.3, s) for i, (w, s) in enumerate(thin)], "path string, seg long, pos int, word string, start double, end double, spk string")
    assert [(r.spk, r.text) for r in folds.speaker_runs(d).orderBy("run").collect()] == [("a", "Oh this is."), ("b", "No not at all b")]


def test_runs_of_words_without_speakers_and_dashes(spark):
    def runs(said, seg_spk="s"):
        rows = [("p", 1, i, w, None if w == "lost" else float(i), None if w == "lost" else i + 0.9, s, seg_spk) for i, (w, s) in enumerate(said)]
        d = spark.createDataFrame(rows, "path string, seg long, pos int, word string, start double, end double, spk string, seg_spk string")
        return [(r.start, r.end, r.spk, r.text) for r in folds.speaker_runs(d).orderBy("run").collect()]

    # a dash breaks a sentence; words without a speaker stay with the last one, blank words go
    assert runs([("you", "a"), ("know—", None), (" ", "b"), ("no", "b"), ("I", ""), ("don't", "b")]) == [(0.0, 1.9, "a", "you know—"), (3.0, 5.9, "b", "no I don't")]
    # at the start the segment's speaker stands in; no times: the word before's end
    assert runs([("oh", None), ("well.", None), ("lost", "b"), ("yes", "b"), ("sir", "b")]) == [(0.0, 1.9, "s", "oh well."), (1.9, 4.9, "b", "lost yes sir")]
    # no speaker at all, one word
    assert runs([("oh", None), ("well.", "")]) == [(0.0, 1.9, "s", "oh well.")] and runs([("oh", "a")], None) == [(0.0, 0.9, "", "oh")]
    # a comma is no break
    assert runs([("yeah,", "a"), ("sure,", "a"), ("you", "b"), ("go", "b"), ("on", "b")]) == [(0.0, 4.9, "b", "yeah, sure, you go on")]


def test_facts(spark):
    from palaver.operators.facts import Rules, extract

    rows = [
        (1, 1, 0, "Host", "Time for fact number one and that is Ann"), (1, 2, 5, "", "Short"), (1, 3, 10, "guest 1", "My fact is that bees"), (1, 4, 12, "guest 1", "can count."), (1, 5, 60, "Bob", "My fact is too near."),
        (1, 6, 200, "Bob", "my fact is about owls, who see"), (1, 7, 203, "", "at night."), (1, 8, 400, "Host", "Time for fact two, Zoe"), (1, 9, 410, "", "Here is something quite long enough."), (2, 1, 0, "Host", "Nothing"),
    ]
    d = spark.createDataFrame(rows, "ep long, id long, t long, spk string, text string")
    got = [tuple(r) for r in extract(d, Rules(r"Time for fact", r"(?i)my fact is", {"Ann": ["Ann"], "Zoe": ["Zoe"]})).orderBy("ep", "n").collect()]
    assert got == [
        (1, 1, 10, "Ann", "Bees can count.", "my", "announced"), (1, 2, 200, "Bob", "Owls, who see at night.", "my", "speaker"), (1, 3, 410, "Zoe", "Here is something quite long enough.", "guess", "announced"),
    ]


def test_who_presents(spark):
    from palaver.operators.facts import Rules, extract

    rules = Rules(r"Fact number", r"(?i)my fact is that", {"Dan": ["Dan", "Daniel"], "Eve": ["Eve"]}, strong="number", opener=r"(?:okay|thanks)\b", mine=r"(?i)that is mine", cue=r"over to ([A-Z][a-z]+)", no_name=["Time"], full_names={"Alex": "Alex Bell"})
    long = "and this is a long sentence for a fact."
    eps = {
        1: [(0, "Dan", "Fact number one, that is mine."), (9, "Dan", f"My fact is that {long}")],
        2: [(0, "Dan", "Fact number one, that is Dan."), (9, "Dan Zed", f"My fact is that {long}")],  # a guest with the announcer's name says it
        3: [(0, "Dan", "Fact number one, Mary."), (9, "", f"My fact is that {long}")],  # a guest by the first name
        4: [(0, "Dan", "Fact number one, over to Russell."), (9, "", "Okay, and here is a long sentence."), (12, "", long)],  # a stranger; an opener is no fact
        5: [(0, "Dan", "Fact number one, over to Alex."), (9, "", long)],
        6: [(0, "Dan", "Fact number one, over to Time."), (9, "", long)],  # nobody named: no guess
        7: [(0, "Dan", "Fact number one."), (9, "Voice 3", f"My fact is that {long}")],  # a label that is nobody
        8: [(0, "Eve", f"Fact number one: my fact is that {long}")],  # in the hand-over's own rest
        9: [(0, "Dan", "Fact number one."), (61, "Eve", f"My fact is that {long}")],  # too late for the slot, but said
    }
    lines = [(e, i, t, s, x) for e, ls in eps.items() for i, (t, s, x) in enumerate(ls)]
    d = spark.createDataFrame(lines, "ep long, id long, t long, spk string, text string")
    guests = spark.createDataFrame([(2, "Dan Zed"), (3, "Mary Roach")], "ep long, guest string")
    told = spark.createDataFrame([(4, "Dan, Eve and (live) Russell T. Davies, who")], "ep long, description string")
    got = {r.ep: (r.who, r.how, r.src) for r in extract(d, rules, guests, told).collect()}
    assert got == {
        1: ("Dan", "announced", "my"), 2: ("Dan Zed", "announced", "my"), 3: ("Mary Roach", "announced", "my"), 4: ("Russell T. Davies", "speaker", "guess"), 5: ("Alex Bell", "speaker", "guess"),
        7: ("", "speaker", "my"), 8: ("Eve", "speaker", "my"), 9: ("Eve", "speaker", "my"),
    }


def test_slots_that_join_in_keep_others_out(spark):
    s = "ep long, id long, t long"
    slots, own = spark.createDataFrame([(1, 1, 0), (1, 2, 50), (1, 9, 400)], s), spark.createDataFrame([(1, 3, 80), (1, 4, 150), (1, 5, 200), (1, 6, 245), (1, 7, 330), (2, 1, 7)], s)
    # 80 is near 0 and 50; 150 joins in, which keeps 200 out (fixed slots alone would let it in); 245 joins; 330 is near 400
    assert sorted(tuple(r) for r in folds.greedy_slots(slots, own).collect()) == [(1, 1, 0, False), (1, 4, 150, True), (1, 6, 245, True), (1, 9, 400, False), (2, 1, 7, True)]


def test_corrections(spark):
    d = spark.createDataFrame([(1, "Jon smith and jon"), (2, None)], "i int, x string")
    new, n = text.corrected(F.col("x"), [(r"\bJon\b", "John"), (r"John smith", "John Smith")])
    assert [tuple(r) for r in d.select(new, n).collect()] == [("John Smith and jon", 2), (None, None)]


def test_a_task_walks_through_many_groups(spark, monkeypatch):
    monkeypatch.setattr(folds, "_OUT", 3, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        d = spark.createDataFrame([(e, i, i * 30) for e in [*range(40), None] for i in range(7)], "ep int, id long, t long")
        f = folds.keep_apart(d, 60)
        assert "FlatMapGroupsInPandas" not in f._jdf.queryExecution().toString()  # a call for each of many small groups costs more than their rows
        got = f.collect()
        assert f.dtypes[0] == ("ep", "int") and sorted((-1 if r.ep is None else r.ep, r.t) for r in got) == [(e, t) for e in range(-1, 40) for t in (0, 60, 120, 180)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_align_by_stretches_equals_one_table(spark):
    rng = random.Random(5)
    x = {(e, p): ([rng.randrange(200) for _ in range(rng.randrange(9))], [rng.randrange(200) for _ in range(rng.randrange(9))]) for e in range(12) for p in "ab"}
    rows = lambda k: spark.createDataFrame([(e, p, i, t) for (e, p), v in x.items() for i, t in enumerate(sorted(v[k]))], "ep long, phrase string, id long, t long")
    f = folds.align(rows(0), rows(1), 12)
    assert "CoGroups" not in f._jdf.queryExecution().toString()
    want = {(e, p, *ij) for (e, p), v in x.items() for ij in folds._aligned(sorted(v[0]), sorted(v[1]), 12)}
    assert {tuple(r) for r in f.collect()} == want and len(want) > 20


def test_topic_words_end_where_ascii_words_do(spark):
    t = [("small", ("of", "de"), 1.0), ("articles", ("the", "th*", "la"), 0.5)]
    assert col(spark, ["éla", "laé", "thé", "lada", "_la", "La.", "de thés the the"], lambda x: topics.topic(x, t)) == ["articles", "articles", "articles", "Other", "Other", "articles", "articles"]


def test_parts_of_a_name_are_written_once(spark):
    d = spark.createDataFrame([("2020-01-02 - #12. The title",), ("2020-01-02 3.5 x",), ("2020-01-02 12th x",), ("#4 bare",), ("2020-01-02 7.5b x",), (None,)], "x string")
    y = d.select(names.number(F.col("x")).alias("n"), names.title(F.col("x")).alias("t"), names.label(F.col("x")).alias("l"), names.kind(F.col("x"), (("(?i)title", "T"),)).alias("k"))
    assert [tuple(r) for r in y.collect()] == [("12", "The title", "#12 The title", "T"), ("3.5", "x", "#3.5 x", "Main"), ("", "12th x", "12th x", "Main"), ("", "bare", "bare", "Main"), ("7", "7.5b x", "#7 7.5b x", "Main"), ("", None, None, "Main")]
    assert len(y._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_texts_put_together_as_row_by_row(spark):
    draw, end = random.Random(5), re.compile(r"[.?!…][\"'”’)]*$")
    said = ["one", "two.", "three? ", " four", "", " ", "five.\n", "six\u00a0", "“seven.”", "eight [hm] x", "[nine]", "ten  x", "é.\u2003", "\n", "w" * 70, "z" * 330, "twelve!)\n", "a\tb", "\x1c.\x1f"]
    rows = [(p, i, float(3 * i + draw.choice([0, 0, 2])), 3 * i + 2.5, draw.choice(["x", "x", "x", "y", None]), draw.choice(said)) for p in "abcdef" for i in range(draw.choice([1, 9, 120]))]
    d = spark.createDataFrame(rows, "path string, pos int, start double, end double, label string, text string")
    cues, sentences, turns = [], [], []
    for p in "abcdef":
        held, some, turn = None, [], []
        for _, _, a, b, label, x in (r for r in rows if r[0] == p):
            if some and not end.search(some[-1][3]) and a - some[-1][2] <= 1 and b - some[-1][1] <= 30:
                some[-1][2:] = [b, f"{some[-1][3]} {x}".strip()]
            else:
                some.append([p, a, b, x])
            if turn and turn[-1][2] == label and a - turn[-1][1] < 40 and not re.search(r"[.?!]$", turn[-1][3]):
                turn[-1][3] += " " + x
            else:
                turn.append([p, int(a), label, x])
            x = " ".join(re.sub(r"\[[^\]]*\]", " ", x).split())
            if x and held and held[3] != label:
                cues.append(held)
                held = None
            if x:
                held = [p, a, b, label, x] if held is None else [p, held[1], b, label, f"{held[4]} {x}"]
                if len(held[4]) >= 320 or len(held[4]) >= 60 and end.search(held[4]):
                    cues.append(held)
                    held = None
        cues += [held] if held else []
        sentences += some
        turns += turn
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups end within batches and go over many
    try:
        key = lambda r: (r[0], r[1])
        assert [list(r) for r in sorted(folds.merge_cues(d).collect(), key=key)] == cues
        assert [list(r) for r in sorted(folds.merge_sentences(d.select("path", "start", "end", "text")).collect(), key=key)] == sentences
        lines = d.select(F.col("path").alias("ep"), F.col("pos").cast("long").alias("id"), F.col("start").cast("long").alias("t"), F.col("label").alias("spk"), "text")
        assert [list(r) for r in sorted(folds.joined_turns(lines).collect(), key=key)] == turns
        # a line without a text stays alone
        odd = spark.createDataFrame([(1, k, 3 * k, "x", t) for k, t in enumerate(["one", None, "two", "three"])], "ep long, id long, t long, spk string, text string")
        assert sorted((r.t, r.text) for r in folds.joined_turns(odd).collect()) == [(0, "one"), (3, None), (6, "two three")]
        pieces = odd.select(F.lit("p").alias("path"), F.col("t").cast("double").alias("start"), (F.col("t") + 2.5).alias("end"), "text")
        assert sorted((r.start, r.text) for r in folds.merge_sentences(pieces).collect()) == [(0.0, "one"), (3.0, None), (6.0, "two three")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
