"""Language-model scores by stupid backoff over counts of the whole corpus.

A token's score is the relative frequency of the longest n-gram ending in it that other documents hold, times ``BACKOFF`` for
each order given up: count(n-gram) / count(its first n - 1 words), at order 1 count(word) / number of words. A document's own
occurrences are taken out of every count, so it can't vouch for itself; a word that no other document holds scores as
one occurrence at the next backoff. Logarithms are summed per document.

The count tables are partitioned by n-gram hash: each block of documents (a run within a partition, at most ``BLOCK_CHARS``
characters or one document more) sends every distinct n-gram once, with its count, to the partition of its hash (ranges of
hashes, as many as Spark has shuffle partitions); there the counts of all blocks are added, joined back to the n-grams that asked, and
returned to the block, where they meet the exploded n-grams of its documents. So an n-gram as frequent as it may be comes once a block.
Hashes travel sorted, as compressed differences: as a row each, counts alone would take more disk than the check tool allows (README).

The texts are read twice. Input that doesn't come straight from files is written to the shared folder first, so that both reads meet the
same rows, also where a task runs again; a block's name is a hash of its content, and blocks that don't meet end the run with an error.

Cases: null and empty texts have no tokens and score 0; repeated rows are documents of their own that vouch for each other; an
empty table gives an empty result; extra columns stay if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import WordHashes, lean, lean_group, scramble, steady, table

ORDER = 3
BACKOFF = 0.4
BLOCK_CHARS = 10_000_000


def _pack(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _sorted_pack(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _sorted_unpack(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=np.uint64)


def grams(words: np.ndarray, place: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For each order, the hash of the n-gram that ends at each word, where the document has begun early enough."""
    h = scramble(words ^ np.uint64(1))
    yield h
    for n in range(2, order + 1):
        h = scramble(h[:-1] * np.uint64(0x9DDFEA08EB382D69) + words[n - 1 :] + np.uint64(n))
        yield h[place[n - 1 :] >= n - 1]


def _blocks(it: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[tuple[int, list[np.ndarray], list[pa.RecordBatch]]]:
    """Blocks of a partition's rows, text first: a name, each row's word hashes, the rows."""
    known, part, done = WordHashes(), TaskContext.get().partitionId(), 0
    docs: list[np.ndarray] = []
    rows: list[pa.RecordBatch] = []
    chars = 0

    def block():
        h = xxhash.xxh3_64(f"{part}.{done}.{','.join(str(len(d)) for d in docs)}")
        for d in docs:
            h.update(d.tobytes())
        return h.intdigest() >> 1, docs, rows

    for batch in it:
        texts, start = batch.column(0), 0
        for i in range(len(texts)):
            text = texts[i].as_py() or ""
            known.bounded()
            words = text.encode("utf-8", "surrogatepass").lower().split()
            docs.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            chars += len(text) + 50
            if chars >= block_chars:
                rows.append(batch.slice(start, i + 1 - start))
                start = i + 1
                yield block()
                docs, rows, chars, done = [], [], 0, done + 1
        if start < len(texts):
            rows.append(batch.slice(start))
    if docs:
        yield block()


def _flat(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, each word's place in its document, each word's document."""
    size = np.array([len(d) for d in docs])
    words = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(docs)), size)
    return words, np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size), doc


def score(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, block_chars: int = BLOCK_CHARS, buckets: int | None = None) -> DataFrame:
    """One row per row of docs: ``keep``, n_tokens, log_score (the sum), mean_log_score (null without tokens) and hits: array<long> of the tokens scored at order 1, 2, ...

    ``buckets`` is the number of partitions of the count tables, by default that of shuffles.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(docs.dtypes)
    names = [f"k{i}" for i in range(len(keep))]
    kept = [f"{n} {kinds[c]}" for n, c in zip(names, keep, strict=True)]
    d = steady(docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)]))
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    @lean
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held, _ in _blocks(it, block_chars):
            words, place, _ = _flat(held)
            sent = [([], []) for _ in range(buckets)]
            for g in grams(words, place, order):  # one order at a time, for memory
                h, n = np.unique(g, return_counts=True)
                cuts = np.searchsorted(h, bounds)
                for (hashes, counts), h_, n_ in zip(sent, np.split(h, cuts), np.split(n, cuts), strict=True):
                    hashes.append(_sorted_pack(h_))
                    counts.append(_pack(n_))
            binary = pa.list_(pa.binary())
            yield pa.record_batch({"block": pa.array([block] * (buckets + 1), pa.int64()), "bucket": pa.array(range(-1, buckets), pa.int32()), "grams": pa.array([[], *(x for x, _ in sent)], binary), "counts": pa.array([[_pack(np.array([len(words)]))], *(x for _, x in sent)], binary)})

    @lean_group
    def add(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() < 0:  # all words, for order 1
            total = _pack(np.array([sum(int(_unpack(c[0])[0]) for c in t.column("counts").to_pylist())]))
            totals = [[total]] * len(t)
        else:
            hashes, counts, totals = t.column("grams").to_pylist(), t.column("counts").to_pylist(), [[] for _ in range(len(t))]
            for k in range(order):
                n = [_unpack(c[k]).astype(np.int64) for c in counts]
                _, at = np.unique(np.concatenate([_sorted_unpack(h[k]) for h in hashes]), return_inverse=True)
                sums = np.bincount(at, weights=np.concatenate(n)).astype(np.int64)[at]
                for row, part in zip(totals, np.split(sums, np.cumsum([len(x) for x in n])[:-1]), strict=True):
                    row.append(_pack(part))
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "total": pa.array(totals, pa.list_(pa.binary()))})

    @lean
    def sequences(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held, rows in _blocks(it, block_chars):
            words, _, _ = _flat(held)
            distinct, at = np.unique(words, return_inverse=True)
            # The block's words and sequence ride on its first document.
            first = lambda b: pa.array([b, *[None] * (len(held) - 1)], pa.binary())
            t = pa.Table.from_batches(rows).select(names) if names else None
            own = {"block": pa.array([block] * len(held), pa.int64()), "place": pa.array(range(len(held)), pa.int32()), "n": pa.array([len(x) for x in held], pa.int32()), "words": first(_sorted_pack(distinct)), "at": first(_pack(at))}
            yield from pa.table({**{c: t.column(c) for c in names}, **own}).to_batches(max_chunksize=20_000)

    schema = ", ".join([*kept, "n_tokens bigint, log_score double, mean_log_score double, hits array<bigint>"])

    @lean_group
    def gather(t: pa.Table) -> pa.Table:
        is_doc = t.column("n").is_valid()
        rows, back = t.filter(is_doc).sort_by("place"), t.filter(pc.invert(is_doc)).sort_by("bucket")
        size = rows.column("n").to_numpy().astype(np.int64)
        if not len(rows) or not len(back):
            raise RuntimeError("a block lacks counts: the rows of docs changed between two reads; give score() a table that is written")
        word = _sorted_unpack(rows.column("words")[0].as_py())
        words = word[_unpack(rows.column("at")[0].as_py()).astype(np.int64)] if len(word) else word
        held = np.split(words, np.cumsum(size)[:-1])
        words, place, doc = _flat(held)
        totals = back.column("total").to_pylist()
        n_all = int(_unpack(totals[0][0])[0])
        # Counts without the document's own, at each word and order; 0 where the document has begun too late.
        others = np.zeros((order, len(words)), np.int64)
        for n, g in enumerate(grams(words, place, order)):
            h, mine = np.unique(g, return_inverse=True)
            count = np.concatenate([_unpack(b[n]) for b in totals[1:]]).astype(np.int64)  # buckets in order: hashes in order
            where = np.flatnonzero(place >= n)
            _, own, times = np.unique(doc[where] * np.int64(len(h) + 1) + mine, return_inverse=True, return_counts=True)
            others[n, where] = count[mine] - times[own]
            del h, mine, count, own, times, where
        rest = n_all - size[doc]
        value = np.log(backoff**order / np.maximum(rest, 1))
        hit = np.full(len(words), -1)
        for n in range(order):
            # The context is the n-gram one shorter that ends a word earlier.
            below = rest if n == 0 else np.concatenate([np.zeros(1, np.int64), others[n - 1, :-1]]) if len(words) else rest
            ok = (others[n] > 0) & (below > 0)
            value[ok] = np.log(backoff ** (order - 1 - n) * others[n, ok] / below[ok])
            hit[ok] = n
        sums = np.bincount(doc, weights=value, minlength=len(rows))
        hits = np.stack([np.bincount(doc[hit == n], minlength=len(rows)) for n in range(order)], axis=1)
        mean = [s / k if k else None for s, k in zip(sums.tolist(), size.tolist(), strict=True)]
        return pa.table([*(rows.column(c) for c in names), pa.array(size), pa.array(sums), pa.array(mean, pa.float64()), pa.array(hits.tolist(), pa.list_(pa.int64()))], names=[*names, "n_tokens", "log_score", "mean_log_score", "hits"])

    # Both reads are of the same columns, so that Spark deals out the same rows to both.
    counts = d.mapInArrow(count, "block bigint, bucket int, grams array<binary>, counts array<binary>").groupBy("bucket").applyInArrow(add, "block bigint, bucket int, total array<binary>")
    told = d.mapInArrow(sequences, ", ".join([*kept, "block bigint, place int, n int, words binary, at binary"]))
    done = told.unionByName(counts, allowMissingColumns=True).groupBy("block").applyInArrow(gather, schema)
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_tokens", "log_score", "mean_log_score", "hits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), *[F.col("hits")[n].alias(f"hits_{n + 1}") for n in range(ORDER)])


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS size
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)),
g AS (
  SELECT *, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c AS (
  SELECT *,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY w, doc_id) AS c1,
    CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY v, w, i >= 2) - count(*) OVER (PARTITION BY v, w, i >= 2, doc_id) ELSE 0 END AS c2,
    CASE WHEN i >= 3 THEN count(*) OVER (PARTITION BY u, v, w, i >= 3) - count(*) OVER (PARTITION BY u, v, w, i >= 3, doc_id) ELSE 0 END AS c3,
    count(*) OVER () - size AS rest
  FROM g),
l AS (SELECT *, lag(c1) OVER d AS b1, lag(c2) OVER d AS b2 FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s AS (
  SELECT doc_id,
    CASE WHEN c3 > 0 AND b2 > 0 THEN 3 WHEN c2 > 0 AND b1 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS hit,
    CASE WHEN c3 > 0 AND b2 > 0 THEN ln(c3::DOUBLE / b2) WHEN c2 > 0 AND b1 > 0 THEN ln(0.4::DOUBLE * c2 / b1) WHEN c1 > 0 THEN ln(0.16::DOUBLE * c1 / rest)
      ELSE ln(0.064::DOUBLE / greatest(rest, 1)) END AS x
  FROM l)
SELECT d.doc_id, count(s.x) AS n_tokens, round(coalesce(sum(s.x), 0), 4) AS log_score,
  count(*) FILTER (WHERE hit = 1) AS hits_1, count(*) FILTER (WHERE hit = 2) AS hits_2, count(*) FILTER (WHERE hit = 3) AS hits_3
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""
