import os
import shutil

import pytest
from pyspark.sql import functions as F

from palaver.functions.stem import has_phrase
from palaver.operators import index
from palaver.sources import sinks
from palaver.sources.store import Store
from palaver.streaming import ingest

T = "ep string, v int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def vtt(*cues):
    return "WEBVTT\n\n" + "\n\n".join(f"00:{t:02d}.000 --> 00:{t + 2:02d}.000\n[{who}] {text}" for t, who, text in cues) + "\n"


def test_store_changes_tables_together(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), buckets=8)
    assert s.read("a") is None and s.manifest() == {}
    a = spark.createDataFrame([(f"e{i}", i) for i in range(20)], T)
    assert s.commit({"a": a, "b": a.limit(0)}) == 1
    assert rows(s.read("a")) == rows(a) and s.read("b").count() == 0
    # only the bucket of e3 is written; its other episodes stay
    k = a.where("ep = 'e3'").select(s.bucket().alias("b")).first()["b"]
    before = s.manifest()["tables"]["a"]["folders"]
    new = s.read("a", [k]).where("ep != 'e3'").unionByName(spark.createDataFrame([("e3", 300)], T))
    s.commit({"a": new}, [k], {"note": 1})
    after = s.manifest()["tables"]["a"]["folders"]
    assert {b for b in after if after[b] != before.get(b)} == {str(k)}
    assert dict(rows(s.read("a"))) == {f"e{i}": i for i in range(20)} | {"e3": 300} and s.manifest()["notes"] == {"note": 1}
    assert rows(s.read("a", version=1)) == rows(a)
    # an emptied bucket; another session finds the store's own number of buckets
    s.commit({"a": new.limit(0)}, [k])
    assert s.read("a", [k]).count() == 0 and Store(spark, s.path, buckets=3).buckets == 8
    assert s.vacuum(1) > 0 and s.versions() == [3] and 0 < s.read("a").count() < 20


def test_a_fault_before_the_pointer_leaves_all_tables(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), buckets=2)
    a = spark.createDataFrame([("x", 1), ("y", 2)], T)
    s.commit({"a": a, "b": a})
    bad = a.withColumn("v", F.expr("if(v = 2, raise_error('broken'), v)").cast("int"))
    with pytest.raises(Exception, match="broken"):
        s.commit({"a": a.withColumn("v", F.lit(9)), "b": bad})
    assert rows(s.read("a")) == rows(s.read("b")) == rows(a) and s.manifest()["version"] == 1
    # a writer that is too late
    late = Store(spark, s.path)
    late.manifest = lambda version=None, m=s.manifest(): m
    s.commit({"a": a})
    with pytest.raises(RuntimeError, match="another writer"):
        late.commit({"a": a.limit(0)})
    assert rows(s.read("a")) == rows(a)


def test_swap_puts_the_old_table_back(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    a, b = spark.createDataFrame([("x", 1)], T), spark.createDataFrame([("y", 2)], T)
    sinks.swap(a, at)
    sinks.swap(spark.read.parquet(at).unionByName(b), at)
    assert rows(spark.read.parquet(at)) == [("x", 1), ("y", 2)]
    real = sinks._fs

    class Stubborn:
        """A file system in which a new table can't be moved to its place."""

        def __init__(self, fs):
            self.fs = fs

        def rename(self, x, y):
            return ".new-" not in x.toString() and self.fs.rename(x, y)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(sinks, "_fs", lambda s, p: (Stubborn(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(RuntimeError, match="could not be replaced"):
        sinks.swap(a, at)
    assert rows(spark.read.parquet(at)) == [("x", 1), ("y", 2)] and os.listdir(tmp_path) == ["t"]


def test_decisions(spark):
    now = spark.createDataFrame([("a", 5.0), ("b", 5.0000004), ("c", 6.0), ("d", 5.0), ("n", None)], "ep string, stamp double")
    then = spark.createDataFrame([("b", 5.0), ("c", 5.0), ("d", None), ("g", 1.0), ("n", 2.0)], "ep string, stamp double")
    assert {r.ep: r.decision for r in index.decisions(now, then).collect()} == {"a": "new", "b": "same", "c": "changed", "d": "changed", "g": "gone", "n": "changed"}
    s = index.stamped(now, [spark.createDataFrame([("a", 9.0), ("a", 7.0), ("c", 2.0), ("z", 1.0)], "ep string, stamp double")])
    assert {r.ep: (r.stamp, r.made) for r in s.where("ep in ('a', 'c')").collect()} == {"a": (9.0, 5.0), "c": (6.0, 6.0)}


@pytest.fixture
def world(spark, tmp_path):
    """A folder of caption files, tables of names and edits, and what refreshing reads them with."""
    folder = tmp_path / "vtts"
    folder.mkdir()

    class World:
        store = Store(spark, str(tmp_path / "store"), buckets=4)
        auto, hand, log, clock = [("a", "S1", "Ann"), ("b", "S1", "Bob")], [], [], 1_700_000_000

        def put(self, name, *cues):
            self.clock += 10
            (folder / f"{name}.vtt").write_text(vtt(*cues))
            os.utime(folder / f"{name}.vtt", (self.clock, self.clock))

        def listing(self):
            return index.stamped(index.listing(spark, str(folder)))

        def refresh(self, stamps=None):
            files = spark.read.text(str(folder), wholetext=True, pathGlobFilter="*.vtt").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.vtt$", 1).alias("ep"), F.col("value").alias("content"))
            e = "ep string, id long, kind string, t long, orig string, label string, value string, ts long"
            return index.refresh(self.store, files, self.listing() if stamps is None else stamps, spark.createDataFrame(self.auto, index.NAMES), spark.createDataFrame(self.hand, index.NAMES), spark.createDataFrame(self.log, e))

        def lines(self):
            return sorted((r.ep, r.t, r.spk, r.src, r.text) for r in self.store.read("lines").collect())

    World.folder = folder
    return World()


def test_index_follows_its_inputs(spark, world):
    world.put("a", (1, "S1", "hello there"), (5, "S2", "running late"))
    world.put("b", (1, "S1", "good day"))
    world.put("empty")
    assert world.refresh() == {"new": 3, "changed": 0, "same": 0, "gone": 0, "version": 1}
    assert world.lines() == [("a", 1, "Ann", "auto", "hello there"), ("a", 5, "", "", "running late"), ("b", 1, "Bob", "auto", "good day")]
    assert world.store.read("search").where(has_phrase(F.col("stems"), "runs late")).select("ep", "id").collect() == [("a", 1)]
    # nothing new but the file without cues, which is looked at again
    assert world.refresh() == {"new": 1, "changed": 0, "same": 2, "gone": 0, "version": 1}
    # one changed, one gone, one new, a name by hand, an edit
    world.put("a", (1, "S1", "hello again"), (5, "S2", "running late"))
    (world.folder / "b.vtt").unlink()
    world.put("c", (2, "S1", "third"))
    world.hand = [("c", "S1", "Cy"), ("a", "S2", "Dee")]
    world.log = [("a", 1, "text", 1, "hello again", "", "hello, again", world.clock), ("a", 2, "delete", 5, "running late", "", "", 5)]
    assert world.refresh() == {"new": 2, "changed": 1, "same": 0, "gone": 1, "version": 2}
    assert world.lines() == [("a", 1, "Ann", "auto", "hello, again"), ("a", 5, "Dee", "hand", "running late"), ("c", 2, "Cy", "hand", "third")]
    # a later edit alone: files are the same, its episode changes in lines and search
    world.log.append(("c", 3, "text", 2, "third", "", "thirds", world.clock))
    assert world.refresh()["version"] == 3
    assert ("c", 2, "Cy", "hand", "thirds") in world.lines() and rows(world.store.read("episodes").select("ep")) == [("a",), ("c",)]
    assert world.refresh()["version"] == 3


def test_a_fault_while_indexing_changes_nothing(spark, world, monkeypatch):
    world.put("a", (1, "S1", "hello there"))
    world.refresh()
    before = {t: rows(world.store.read(t)) for t in ("lines", "episodes", "names")}
    world.put("a", (1, "S1", "changed"))
    monkeypatch.setattr(index, "stems", lambda c: F.expr("raise_error('no stems')").cast("array<string>"))
    with pytest.raises(Exception, match="no stems"):
        world.refresh()
    assert {t: rows(world.store.read(t)) for t in before} == before
    monkeypatch.undo()
    assert world.refresh()["changed"] == 1 and world.lines()[0][4] == "changed"


def test_listings_as_a_stream(spark, world, tmp_path):
    """A new, a changed, an unchanged and a removed file; a restart in between."""
    inbox, n = tmp_path / "listings", [0]
    inbox.mkdir()

    def take():
        n[0] += 1
        rows_ = world.listing().withColumn("at", F.lit(n[0])).select("at", "ep", "stamp", "made")
        rows_.coalesce(1).write.json(str(tmp_path / f"l{n[0]}"))
        for f in (tmp_path / f"l{n[0]}").glob("part-*.json"):
            shutil.copy(f, inbox / f"{n[0]}.json")

    def run():
        got = []
        s = spark.readStream.schema("at long, ep string, stamp double, made double").json(str(inbox))
        q = ingest.watch(s, str(tmp_path / "state"), lambda stamps: got.append(world.refresh(stamps)))
        assert q.awaitTermination(120) and q.exception() is None
        return got

    world.put("same", (1, "S1", "one"))
    world.put("changes", (1, "S1", "two"))
    world.put("goes", (1, "S1", "three"))
    take()
    assert [(g["new"], g["version"]) for g in run()] == [(3, 1)]
    folders = world.store.manifest()["tables"]["lines"]["folders"]
    world.put("changes", (1, "S1", "two, again"))
    take()
    (world.folder / "goes.vtt").unlink()
    world.put("comes", (1, "S1", "four"))
    take()
    assert run() == [{"new": 1, "changed": 1, "same": 1, "gone": 1, "version": 2}]
    assert [(e, x) for e, _, _, _, x in world.lines()] == [("changes", "two, again"), ("comes", "four"), ("same", "one")]
    assert run() == [] and folders != world.store.manifest()["tables"]["lines"]["folders"]
