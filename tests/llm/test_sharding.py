import math
import zlib
from collections import Counter
from dataclasses import replace

import xxhash
from pyspark.sql import functions as F

from palaver.llm import sharding
from palaver.llm.sharding import Rack, Region, Shard, Tree, even_tree


def draw(key, name, weight):
    """Plain version: Spark's hash of two strings chains the first one's hash as the second one's seed."""
    h = xxhash.xxh64(name.encode(), seed=42).intdigest()
    h = h if key is None else xxhash.xxh64(str(key).encode(), seed=h).intdigest()
    return -math.log(((h >> 11) + 0.5) / 2**53) / weight


def plain(key, tree):
    g = min(range(len(tree.regions)), key=lambda i: (draw(key, f"region/{i}", tree.regions[i].weight), i))
    late = min(((draw(key, f"added/{a}/{b}/{s.number}", s.weight), s.number) for a, b, s in tree.added), default=(math.inf, None))
    if late[0] < draw(key, f"region/{g}", tree.regions[g].weight):
        return late[1]
    racks = tree.regions[g].racks
    r = min(range(len(racks)), key=lambda i: (draw(key, f"rack/{g}/{i}", racks[i].weight), i))
    place, shards = sum(len(x.racks) for x in tree.regions[:g]) + r, racks[r].shards
    return shards[min(range(len(shards)), key=lambda i: (draw(key, f"shard/{place}/{i}", shards[i].weight), i))].number


UNEVEN = Tree((Region((Rack((Shard(0, 2.0), Shard(1)), 3.0), Rack((Shard(2),), 1.0)), 4.0), Region((Rack((Shard(3), Shard(4), Shard(5, 0.5)), 2.5),), 2.5)))


def shards(spark, tree, n=20_000):
    return {r.id: r.shard for r in sharding.assign(spark.range(n), "id", tree).collect()}


def test_query_equals_plain_version(spark, sf):
    out = sharding.query(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    tree = even_tree(2, 2, 4)
    then = tree.grown(1, 1, Shard(16))
    want = {d.doc_id: (len(d.text.encode()) + 1, zlib.crc32(d.text.encode()), "key", plain(d.doc_id, tree), plain(d.doc_id, then)) for d in docs}
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in out} == want and len(out) == len(docs)
    for s, n in Counter(r.shard for r in out).items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))


def test_shares_follow_weights(spark):
    n, got = 20_000, shards(spark, UNEVEN)
    assert got[17] == plain(17, UNEVEN)
    for s, share in UNEVEN.shares().items():
        assert abs(Counter(got.values())[s] - n * share) < 5 * math.sqrt(n * share)
    grown = UNEVEN.grown(0, 1, Shard(9, 2.0))
    then = shards(spark, grown)
    assert all(then[k] in (got[k], 9) for k in got)
    for s, share in grown.shares().items():
        assert abs(Counter(then.values())[s] - n * share) < 5 * math.sqrt(n * share)
    again = shards(spark, grown.grown(1, 0, Shard(12)))
    assert all(again[k] in (then[k], 12) for k in then)


def test_movement_stays_in_the_subtree_whose_weight_changes(spark):
    before, (a, b) = shards(spark, UNEVEN), UNEVEN.regions
    # a shard's weight: within its rack, and only into the heavier shard
    heavier = replace(a.racks[0], shards=(Shard(0, 2.0), Shard(1, 3.0)))
    after = shards(spark, Tree((replace(a, racks=(heavier, a.racks[1])), b)))
    assert {(before[k], after[k]) for k in before if before[k] != after[k]} == {(0, 1)}
    # a rack's weight: within its region, into that rack
    after = shards(spark, Tree((replace(a, racks=(a.racks[0], replace(a.racks[1], weight=4.0))), b)))
    assert {(before[k], after[k]) for k in before if before[k] != after[k]} == {(0, 2), (1, 2)}
    # a region's weight: into that region
    after = shards(spark, Tree((a, replace(b, weight=6.0))))
    assert all(before[k] < 3 <= after[k] for k in before if before[k] != after[k])


def test_edges(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (None, None, None), (None, "", "y"), (2, None, "y"), (3, "é" * 50_000, "z")] + [(7, "same", "q")] * 40
    d = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumns({"slot": F.lit("s"), "size": F.lit(0), "id": F.lit(5), "_n": F.lit(1)})
    tree = even_tree(1, 1, 2)
    out = sharding.place(d, tree).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32, r.shard) for r in out) == sorted(((i is None, i or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain(i, tree)) for i, t, _ in rows)
    assert {r.grown_shard for r in out} == {None}
    for s, n in Counter(r.shard for r in out).items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, sharding.place(d.repartition(3), tree).collect()), key=repr)
    assert sharding.place(d.limit(0), tree, tree.grown(0, 0, Shard(2))).count() == 0


def test_files_and_movement(spark, sf, tmp_path):
    docs, tree = spark.read.parquet(f"{sf}/documents.parquet"), even_tree(2, 2, 2)
    then = tree.grown(0, 0, Shard(8))
    sharding.write(docs, tree, str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, plain(r.doc_id, tree)) for r in docs.collect()} and back.count() == docs.count()
    moved = sharding.movement(sharding.place(docs, tree, then)).collect()
    assert {r.grown_shard for r in moved} == {8} and sum(r.n for r in moved) == sum(plain(r.doc_id, then) == 8 for r in docs.collect())
