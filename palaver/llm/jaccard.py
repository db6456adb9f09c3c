"""N-gram Jaccard join by prefix filters under several token orders.

A document's set holds its distinct five-word shingles (as 64-bit hashes). Under one order of all tokens, two sets of Jaccard
similarity t share a token among their first n - ceil(t n) + 1. Each of the orders here puts tokens that many documents
share last, by their count's power of two, and breaks ties by a hash of its own; a pair has to share prefix tokens under all
of them before its sets are compared. The counts that order the tokens are found within blocks of documents and summed up; the
``HEAVY`` commonest are broadcast, and whatever they miss, every order is the same for all documents, so no pair is lost.

Equal sets are one node (named by the hash of the set), so exact copies meet once. Within a token's list of nodes, pairs
are first tried against the node in which the list's token stands first (the one with fewest tokens of its own); those found similar join into components, and only nodes of different
components in one list are then paired with each other. So components cost about as many comparisons as a group has
members, and a link between different components is never skipped. Where links are to be counted, every pair of nodes of a component is then
compared in full, in pairs of blocks: the square of a component's different sets, as the count calls for.

Cases: null and empty texts have no set, and link with nothing; fewer than five words are one shingle; a row whose id is null
gets its n_shingles and a null component; rows that repeat an id are one node of the graph; ties of ids take the least; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.common import CACHED_WORDS, WordHashes, checkpoint, components, discard, lean, lean_group, scramble, table, written

WORDS = 5
PERCENT = 80
#: At most so many common tokens are broadcast (16 bytes each); they only order tokens.
HEAVY = 1 << 19
#: Tokens that fewer documents of a block share don't count as common.
LOCAL_LEAST = 3
BLOCK_DOCS = 8_192
#: A block of documents ends at so many tokens as well.
BLOCK_TOKENS = 4_000_000
#: Seeds of the token orders.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Up to so many rows (of some 50 bytes) of documents wanted for verification are broadcast; beyond, texts are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Members of a list head compared in one task's stretch.
STRETCH = 256
#: Nodes of a component that meet as a block, and tokens whose columns stand in memory at once.
BLOCK, COLUMNS = 256, 4096


def shingles(text: str | None, known: WordHashes, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; A-Z count as lower case, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    known.bounded()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    width = min(k, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9DDFEA08EB382D69) + w[i : len(w) - width + 1 + i]
    return np.unique(scramble(h))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _node(s: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def survey(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n_shingles) per row, node null where the set is empty; and (token, n), the counts of tokens within blocks of documents.

    One read of the texts gives both: a written table, of which the counts are those that ``LOCAL_LEAST`` documents of a block share.
    """

    @lean
    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, seen, size = WordHashes(), [], set(), 0

        def flush():
            tokens, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            common = n >= LOCAL_LEAST
            tokens, n = _signed(tokens[common]), n[common].astype(np.int64)
            return pa.record_batch([pa.nulls(len(n), kind_), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64()), pa.array(tokens), pa.array(n)], names=names)

        for b in it:
            kind_ = b.schema.field(0).type
            sets = [shingles(t.as_py(), known, k) for t in b.column(1)]
            nodes = [_node(s) if len(s) else None for s in sets]
            rows = [b.column(0), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names=names)
            for s, node in zip(sets, nodes, strict=True):
                if node is not None and node not in seen:
                    seen.add(node)
                    held.append(s)
                    size += len(s)
                if len(held) >= BLOCK_DOCS or size >= BLOCK_TOKENS:
                    yield flush()
                    held, seen, size = [], set(), 0
        if held:
            yield flush()

    names, kind = ["doc_id", "node", "n_shingles", "token", "n"], dict(docs.dtypes)[id_col]
    both = written(docs.select(id_col, text_col).mapInArrow(f, f"doc_id {kind}, node bigint, n_shingles bigint, token bigint, n bigint"), "survey")
    return both.where("n_shingles IS NOT NULL").select("doc_id", "node", "n_shingles"), both.where("n_shingles IS NULL").select("token", "n")


def heavy_tokens(counts: DataFrame, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """The commonest tokens, sorted, and each one's power of two: at most ``most``, by counts within blocks of documents."""
    counts = checkpoint(counts.groupBy("token").agg(F.sum("n").alias("n")))
    # The least power of two whose tokens, with all above it, stay within the bound.
    power = F.floor(F.log2("n")).cast("int")
    least, total = 99, 0
    for p, n in sorted(counts.groupBy(power.alias("p")).count().collect(), reverse=True):  # a row for each power of two
        total += n
        if total > most:
            break
        least = p
    rows = counts.where(power >= least).select("token", power.alias("p")).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["p"].to_numpy(np.int64)[order]


def prefix(s: np.ndarray, heavy: np.ndarray, power: np.ndarray, seed: int, percent: int = PERCENT) -> np.ndarray:
    """The tokens of a set that come first under an order, in that order, as many as similarity calls for."""
    n = len(s) - (percent * len(s) + 99) // 100 + 1
    key = scramble(s ^ np.uint64(seed))
    if not len(heavy):
        return s[np.argsort(key)[:n]]
    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    rank = np.where(heavy[at] == s, power[at] + 1, 0)
    return s[np.lexsort((key, rank))[:n]]


def postings(docs: DataFrame, common_tokens: tuple[np.ndarray, np.ndarray], text_col: str = "text", k: int = WORDS, percent: int = PERCENT, orders: Sequence[int] = ORDERS) -> DataFrame:
    """(ord, token, node, n, pos, head): the nodes under every prefix token that at least two nodes share; head is the one in which it stands first.

    Two sets whose first common token stands at pos in both share at most n - pos tokens, the less of the two. Rows that leave too
    few for any partner in their list go at once. A node comes at most once from each task.
    """
    heavy = docs.sparkSession.sparkContext.broadcast(common_tokens)

    @lean
    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (common, power) = WordHashes(), heavy.value
        seen: set[int] = set()
        for b in it:
            parts: list[tuple[int, np.ndarray, int, int]] = []
            for t in b.column(0):
                s = shingles(t.as_py(), known, k)
                if len(s) and (name := _node(s)) not in seen:
                    seen.add(name)
                    parts += [(o, prefix(s, common, power, seed, percent), name, len(s)) for o, seed in enumerate(orders)]
            if len(seen) > CACHED_WORDS:
                seen.clear()
            if parts:
                size = [len(p[1]) for p in parts]
                rep = lambda i, kind: np.repeat(np.array([p[i] for p in parts], kind), size)
                yield from pa.table({"ord": rep(0, np.int8), "token": _signed(np.concatenate([p[1] for p in parts])), "node": rep(2, np.int64), "n": rep(3, np.int32), "pos": np.concatenate([np.arange(k, dtype=np.int32) for k in size])}).to_batches(max_chunksize=50_000)

    rows = docs.select(text_col).mapInArrow(f, "ord tinyint, token bigint, node bigint, n int, pos int")
    line = Window.partitionBy("ord", "token")
    head = F.min(F.struct("pos", "node", "n")).over(line)
    shared = rows.withColumns({"lo": F.min("node").over(line), "hi": F.max("node").over(line), "least": F.min("n").over(line), "head": head}).where("lo != hi")
    enough = (F.col("n") - F.col("pos")) * (100 + percent) >= (F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))) * percent
    out = written(shared.where(enough).select("ord", "token", "node", "n", "pos", "head"), "postings")
    heavy.unpersist()
    return out


def _in_all_orders(pairs: DataFrame, n_orders: int) -> DataFrame:
    """(a, b) pairs that every order brings."""
    return pairs.groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1, cast(ord AS int))")).alias("by")).where(F.col("by") == (1 << n_orders) - 1).select("a", "b")


def _may_link(x: str, y: str, percent: int):
    """Whether sizes, and what is left after the common token, allow two rows of a list to be similar."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    left = F.least(n - F.col(f"{x}pos"), m - F.col(f"{y}pos"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (left * (100 + percent) >= (n + m) * percent)


def verify(docs: DataFrame, members: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b, alike) of pairs of nodes, their sets compared in full.

    Every node is read from the text of one document. A pair's head a meets its partners in stretches of ``STRETCH``.
    """
    one = members.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("_id"))
    # Heads with many partners are dealt over several stretches.
    p = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("a")) / STRETCH)))
    wanted = p.select(F.col("a").alias("node"), "a", "part").distinct().unionByName(p.select(F.col("b").alias("node"), "a", "part"))
    wanted = checkpoint(wanted.join(one, "node").groupBy("_id", "node").agg(F.collect_list(F.struct("a", "part")).alias("at")))
    small = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    j = texts.join(F.broadcast(wanted) if small else wanted, F.col("_doc") == F.col("_id")).select("_text", "node", "at")

    @lean
    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in it:
            out: list[tuple] = []
            for t, node, at in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = shingles(t.as_py(), known, k)
                if len(s) and _node(s) == node:  # an id may name other texts as well
                    out += [(x["a"], x["part"], node, s.tobytes()) for x in at]
            for i in range(0, len(out), 500):
                a, part, node, s = zip(*out[i : i + 500], strict=True)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "part": pa.array(part, pa.int64()), "node": pa.array(node, pa.int64()), "tokens": pa.array(s, pa.binary())})

    dealt = j.mapInArrow(sets, "a bigint, part bigint, node bigint, tokens binary").repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("node"), "node")

    @lean
    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, last = None, np.zeros(0, np.uint64), None
        for b in it:
            a_, b_, ok = [], [], []
            for a, node, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if node == a:
                    head, own, last = a, s.copy(), None
                elif head == a and node != last:
                    last = node
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    a_.append(a)
                    b_.append(node)
                    ok.append(100 * both >= percent * (len(own) + len(s) - both))
            if a_:
                yield pa.record_batch({"a": pa.array(a_, pa.int64()), "b": pa.array(b_, pa.int64()), "alike": pa.array(ok, pa.bool_())})

    return dealt.mapInArrow(compare, "a bigint, b bigint, alike boolean")


def links_within(docs: DataFrame, members: DataFrame, comp: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(node, n): how many documents the nodes linked to each node name, of components (node, component_id): every pair of a component's nodes compared in full.

    A component's nodes are dealt into blocks of about ``block``; pairs of blocks meet, so a set is read once and sent once for each block of its component.
    """
    named = members.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("m"))
    sizes = comp.groupBy("component_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    c = comp.join(sizes, "component_id").join(named, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = checkpoint(c.groupBy("_id", "node").agg(F.first(F.struct("component_id", "blocks", "own", "m")).alias("at")))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    j = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, F.col("_doc") == F.col("_id")).select("_text", "node", "at")

    @lean
    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in it:
            out: list[tuple] = []
            for t, node, at in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = shingles(t.as_py(), known, k)
                if len(s) and _node(s) == node:  # an id may name other texts as well
                    out += [(at["component_id"], min(at["own"], o), max(at["own"], o), at["own"], node, at["m"], s.tobytes()) for o in range(at["blocks"])]
            for i in range(0, len(out), 500):
                comp_, lo, hi, own, node, m, s = zip(*out[i : i + 500], strict=True)
                yield pa.record_batch({"comp": pa.array(comp_, pa.int64()), "i": pa.array(lo, pa.int32()), "j": pa.array(hi, pa.int32()), "own": pa.array(own, pa.int32()), "node": pa.array(node, pa.int64()), "m": pa.array(m, pa.int64()), "tokens": pa.array(s, pa.binary())})

    def compare(t: pa.Table) -> pa.Table:
        nodes, first = np.unique(t.column("node").to_numpy(), return_index=True)  # a node comes more than once where an id repeats
        t = t.take(pa.array(first))
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens")]
        own, m, n = t.column("own").to_numpy(), t.column("m").to_numpy(), np.array([len(s) for s in held])
        token, at, often = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(held)), n)
        # tokens that several sets share, some thousand at a time, as columns of a matrix of 0 and 1
        place = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[at]
        row, place = row[place >= 0], place[place >= 0]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        both = np.zeros((len(held), len(held)), np.float32)
        for a in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
            lo, hi = np.searchsorted(place, (a, a + COLUMNS))
            x = np.zeros((len(held), COLUMNS), np.float32)
            x[row[lo:hi], place[lo:hi] - a] = 1
            both += x @ x.T
        both = both.astype(np.int64)
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        np.fill_diagonal(linked, False)
        if t.column("i")[0].as_py() != t.column("j")[0].as_py():
            linked &= own[:, None] != own[None, :]
        return pa.table({"node": nodes, "n": linked @ m})

    rows = j.mapInArrow(sets, "comp bigint, i int, j int, own int, node bigint, m bigint, tokens binary")
    return rows.groupBy("comp", "i", "j").applyInArrow(lean_group(compare), "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, orders: Sequence[int] = ORDERS, links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the size of its set and the least id that links of the given similarity reach.

    With ``links`` also n_links: how many other rows (with an id) have a similar set, copies included.
    """
    members, counts = survey(docs, id_col, text_col, k)
    lists = postings(docs, heavy_tokens(counts), text_col, k, percent, orders)
    how = dict(id_col=id_col, text_col=text_col, k=k, percent=percent)
    line = Window.partitionBy("ord", "token")

    # Each list against the node in which its token stands first: one with few tokens of its own.
    stars = lists.where((F.col("node") != F.col("head.node")) & _may_link("", "head.", percent)).select("ord", F.col("head.node").alias("a"), F.col("node").alias("b"))
    tried = checkpoint(verify(docs, members, _in_all_orders(stars, len(orders)), **how))
    found = components(tried.where("alike"), "a", "b")

    # What is left: nodes of one list in different components.
    placed = lists.join(found, "node", "left").withColumn("comp", F.coalesce("component_id", "node")).select("ord", "token", "node", "n", "pos", "comp")
    mixed = checkpoint(placed.withColumns({"lo": F.min("comp").over(line), "hi": F.max("comp").over(line)}).where("lo != hi").drop("lo", "hi"))
    x, y = mixed.alias("x"), mixed.alias("y")
    on = (F.col("x.ord") == F.col("y.ord")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & _may_link("x.", "y.", percent)
    crossed = x.join(y, on).select("x.ord", F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    rest = _in_all_orders(crossed, len(orders)).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    more = checkpoint(verify(docs, members, rest, **how).where("alike"))
    linked = tried.where("alike").select("a", "b").unionByName(more.select("a", "b"))

    # Nodes and ids are one graph: rows that repeat an id connect their nodes as links do.
    known = members.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    same = known.withColumn("a", F.min("node").over(Window.partitionBy("doc_id"))).where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b"))
    comp = components(linked.unionByName(same), "a", "b")
    discard(lists)  # what follows reads checkpoints alone
    m = members.join(comp, "node", "left").withColumn("comp", F.coalesce("component_id", "node"))
    least = m.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("least"))
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    out = m.join(least, "comp", "left").select("doc_id", "node", "n_shingles", mine.alias("component_id"))
    if not links:
        return out.drop("node")
    # Components by links alone: a repeated id makes no two texts similar.
    near = links_within(docs, members, checkpoint(components(linked, "a", "b")), id_col, text_col, k, percent)
    copies = known.groupBy("node").agg(F.count(F.lit(1)).alias("m")).join(near, "node", "left").select(F.col("node").alias("_node"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("_links"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_links", F.lit(0))).otherwise(0).cast("long")
    return out.join(copies, F.col("node") == F.col("_node"), "left").select("doc_id", "n_shingles", "component_id", own.alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), links=True)
