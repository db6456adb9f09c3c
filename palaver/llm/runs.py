"""Periodic runs of words by a harmonic grid.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and ``TIMES`` x q long, that no neighbouring word
extends. For each period p the grid asks, for all j, how far words agree from jp and (j+1)p on (forward) and before them (backward); the two
answers bound the stretch of period p around them, exactly and whole. Each question is a range minimum over the common prefixes of neighbours in a
suffix array, of the words and of the words reversed; a text of n words costs n ln n questions. Periods that aren't the smallest of their
stretch give the same stretch again, so the least one stays.

A word in a run occurs ``TIMES`` times or more in its text, so texts are first cut at words that don't, and the grid goes over the pieces of
``LEAST`` words or more. This is exact and leaves little of common prose. Pieces of many texts share one suffix array (each ends in a mark of its own),
of ``TOGETHER`` words or one piece. Texts don't meet: there is no shuffle, and a task holds one Arrow batch and the arrays of one such group.

Cases: null texts and such without words have no run; a null id leaves its text as it is in ``planted``; rows that repeat an id or a text are
rows of their own; of runs of equal length the first by start, then period is reported; an empty table gives an empty result; extra columns are
not read. A very long piece of n words takes some 200 n bytes x log2(n) / 17.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import lean, table

LEAST = 6
TIMES = 4
#: Words that share a suffix array; a single longer piece has its own.
TOGETHER = 200_000
#: Grid questions asked at once.
ASKED = 1_000_000


class Extensions:
    """How far the words from two places on agree: a suffix array, the common prefixes of its neighbours, and range minima over them.

    ``words`` are numbers from 0 on, and the words of different pieces, the marks at their ends included, are different.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
        levels, width = [rank], 1
        while rank.max(initial=0) < n:  # prefix doubling: ranks of the first 2, 4, 8 ... words
            behind = np.zeros(n, np.int64)
            behind[: n - width] = rank[width:]
            rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64) + 1
            levels.append(rank)
            width *= 2
        self.rank = rank - 1
        suffixes = np.empty(n, np.int64)
        suffixes[self.rank] = np.arange(n)
        # Neighbours' common prefixes: from the widest ranks down, step over what agrees.
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            padded = np.append(levels[k], 0)
            same = (a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
            a[same] += 1 << k
            b[same] += 1 << k
        rows = [(a - suffixes[:-1]).astype(np.int32)]
        while (1 << len(rows)) <= n - 1:
            half = 1 << (len(rows) - 1)
            row = rows[-1].copy()
            np.minimum(row[:-half], rows[-1][half:], out=row[:-half])
            rows.append(row)
        self.minima = np.stack(rows)

    def ahead(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """For each pair of different places, the number of words that agree from there on."""
        x, y = self.rank[i], self.rank[k]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        return np.minimum(self.minima[level, lo], self.minima[level, hi - (1 << level)])


def grid(starts: np.ndarray, sizes: np.ndarray, times: int = TIMES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(piece, p, place of jp) for each piece, each p to a ``times``-th of its size, and each j with (j+1)p in the piece; some at once."""
    most = sizes // times
    piece = np.repeat(np.arange(len(sizes)), most)
    p = np.arange(len(piece)) - np.repeat(np.cumsum(most) - most, most) + 1
    asked = (sizes[piece] - 1) // p
    total = np.cumsum(asked)
    begin = 0
    while begin < len(p):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + ASKED, "right")))
        of = np.repeat(np.arange(begin, end), asked[begin:end])
        j = np.arange(len(of)) - np.repeat(np.cumsum(asked[begin:end]) - asked[begin:end], asked[begin:end])
        yield piece[of], p[of], starts[piece[of]] + j * p[of]
        begin = end


def runs_of(pieces: Sequence[np.ndarray], least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(piece, start, length, period) of all runs of the pieces (words as numbers), by piece, start and period."""
    sizes = np.array([len(x) for x in pieces], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    above = np.cumsum([int(x.max()) + 1 for x in pieces])  # a piece's words lie above those of the pieces before it
    low = np.concatenate([[0], above[:-1]])
    words = np.concatenate([np.append(x + o, above[-1] + k) for k, (x, o) in enumerate(zip(pieces, low.tolist(), strict=True))])
    n = len(words)
    forward = Extensions(words)
    # Reversed, a piece's mark stands before it: place x of the words is place n - 2 - x of the words reversed, whose last is a mark again.
    backward = Extensions(np.append(words[:-1][::-1], above[-1] + len(pieces)))
    found = []
    for piece, p, i in grid(starts, sizes, times):
        k = i + p
        f = forward.ahead(i, k)
        b = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > starts[piece])
        b[inner] = backward.ahead(n - 2 - (i[inner] - 1), n - 2 - (k[inner] - 1))
        good = f + b + p >= np.maximum(least, times * p)
        if good.any():
            begin = (i - b)[good]
            found.append(np.unique(np.stack([piece[good], begin - starts[piece[good]], (f + b + p)[good], p[good]]), axis=1))
    if not found:
        return tuple(np.zeros((4, 0), np.int64))
    rows = np.unique(np.concatenate(found, axis=1), axis=1)
    first = np.ones(rows.shape[1], bool)  # of one stretch the least period
    first[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    piece, start, length, period = rows[:, first]
    order = np.lexsort((period, start, piece))
    return piece[order], start[order], length[order], period[order]


def pieces_of(words: Sequence[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, np.ndarray]]:
    """(place, words as numbers) of the stretches of ``least`` words or more, each of which the text has ``times`` times or more."""
    if len(words) < least:
        return []
    known: dict[bytes, int] = {}
    at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    often = np.concatenate([[False], np.bincount(at)[at] >= times, [False]])
    edge = np.flatnonzero(often[1:] != often[:-1]).reshape(-1, 2)
    return [(int(a), at[a:b]) for a, b in edge if b - a >= least]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with those of every tenth id's end made periodic, as the query's contract has it."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, plant: bool = False) -> DataFrame:
    """(id, n_words, runs, collapsed) per row: runs by start and period, collapsed the words without those that repeat a run's first period."""
    return _found(docs, id_col, text_col, least, times, plant, digests=False)


def _found(docs: DataFrame, id_col: str, text_col: str, least: int, times: int, plant: bool, digests: bool) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    shown = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])
    digest = pa.schema([("n_runs", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def told(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        if runs:
            gone = np.zeros(len(words) + 1, np.int64)
            for start, length, q in runs:
                gone[start + q] += 1
                gone[start + length] -= 1
            kept = b" ".join(w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g)
        else:
            kept = b" ".join(words)
        if not digests:
            return len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], kept.decode("utf-8", "replace")
        start, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        every = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return len(runs), start, length, q, None if q is None else 1000 * length // q, hashlib.sha256(every.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()

    def group(ids: pa.Array, texts: list[list[bytes]], pieces: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        of: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if pieces:
            for k, start, length, q in zip(*(x.tolist() for x in runs_of([p for _, _, p in pieces], least, times)), strict=True):
                of[pieces[k][0]].append((pieces[k][1] + start, length, q))
        rows = list(zip(*map(told, texts, of), strict=True))
        schema = digest if digests else shown
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t.type) for c, t in zip(rows, schema, strict=True))], names=["id", *schema.names])

    @lean
    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts, pieces, words, chars = [], [], [], 0, 0
            kinds = batch.schema.field(0).type
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                own = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                own = planted(i.as_py(), own) if plant else own
                for at, p in pieces_of(own, least, times):
                    pieces.append((len(texts), at, p))
                    words += len(p) + 1
                ids.append(i.as_py())
                texts.append(own)
                chars += len(own)
                if words >= TOGETHER or chars >= 5 * TOGETHER:
                    yield group(pa.array(ids, kinds), texts, pieces)
                    ids, texts, pieces, words, chars = [], [], [], 0, 0
            if ids:
                yield group(pa.array(ids, kinds), texts, pieces)

    columns = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string" if digests else "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(f, f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(table(spark, sf_dir, "documents"), "doc_id", "text", LEAST, TIMES, plant=True, digests=True)
