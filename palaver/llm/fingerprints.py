"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms whose inverse document frequency over all documents lies in a band, so neither words of every
text nor one-offs count. A document's distinct lexicon terms are sorted and hashed under several random subsets of
the lexicon; equal hashes mean that the documents agree on a whole subset. Subsets come in rates of 1, 1/2, 1/4, ... of the
lexicon, ``SUBSETS`` of each, and a fingerprint keeps the three rates at which about one or two of its terms
fall in a subset, so that long and short texts both survive an edit in part. ``likeness`` is the share of non-empty subsets that agree, at the
rate where it is highest. A hash of all terms leads the fingerprint: where it is equal, likeness is 1.

The lexicon is broadcast, as 8 bytes a term. Its size is bounded: a term in it is in a share of at least exp(-idf_max) of
the documents, so there are at most exp(idf_max) times the mean number of distinct terms in a document, however many documents there are.

``edited_pairs`` gives each text its successor by falling id (after the last, the first): documents are dealt by ranges of
the id, sorted there, and each range also gets the first document of the next one.

Cases: null text counts as empty; texts without terms have the hash of no terms and agree with each other; a null id stands last; rows
that repeat an id stand by falling text; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import CACHED_WORDS, lean, scramble, table

#: The band of ln(documents / documents with the term).
IDF = (3.0, 7.6)
SUBSETS = 16
_TERMS = re.compile(r"[^\W_]+")
_SEEDS = np.array([xxhash.xxh3_64_intdigest(f"lexicon {i}".encode()) for i in range(SUBSETS)], np.uint64)


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


def terms(text: str | None, known: dict[str, int]) -> np.ndarray:
    """The sorted hashes of a text's distinct terms."""
    if len(known) > CACHED_WORDS:
        known.clear()
    words = set(_TERMS.findall((text or "").lower()))
    return np.sort(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))


def lexicon(docs: DataFrame, text_col: str = "text", idf: tuple[float, float] = IDF) -> np.ndarray:
    """The sorted hashes of the terms in the band."""

    @lean
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()

        def flush():
            h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in df), np.uint64, len(df))
            return pa.record_batch({"term": pa.array(h.view(np.int64)), "n": pa.array(list(df.values()), pa.int64())})

        for b in it:
            for t in b.column(0):
                df.update(set(_TERMS.findall((t.as_py() or "").lower())))
            if len(df) > 2_000_000:
                yield flush()
                df = Counter()
        yield flush()

    total = docs.count()
    df = docs.select(text_col).mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    share = F.log(F.lit(float(max(total, 1))) / F.col("n"))
    rows = df.where((F.col("n") >= 2) & (share >= idf[0]) & (share <= idf[1])).select("term").toPandas()
    return np.sort(rows["term"].to_numpy(np.int64).view(np.uint64))


def fingerprint(text: str | None, lex: np.ndarray, known: dict[str, int]) -> str:
    """Hash of all terms, then rate:hashes for three rates; a subset without terms has the hash 0."""
    t = terms(text, known)
    out = [f"{xxhash.xxh3_64_intdigest(t.tobytes()):016x}"]
    if len(lex) and len(t):
        t = t[lex[np.minimum(np.searchsorted(lex, t), len(lex) - 1)] == t]
        if len(t):
            drawn = scramble(t[:, None] ^ _SEEDS[None, :])
            values = scramble(drawn)
            best = max(0, round(np.log2(len(t) / 1.4)))
            for rate in range(max(0, best - 1), best + 2):
                inside = drawn <= np.uint64((1 << 64 - rate) - 1)
                h = np.where(inside, values, np.uint64(0)).sum(axis=0, dtype=np.uint64)
                short = np.where(inside.any(axis=0), h % np.uint64(65535) + np.uint64(1), np.uint64(0))
                out.append(f"{rate}:{short.astype('>u2').tobytes().hex()}")
    return ".".join(out)


def likeness(a: str, b: str) -> float:
    """From 0 to 1, of two fingerprints."""
    if a[:16] == b[:16]:
        return 1.0
    best, rates = 0.0, dict(x.split(":") for x in b.split(".")[1:])
    for rate, x in (x.split(":") for x in a.split(".")[1:]):
        if rate in rates:
            p, q = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (x, rates[rate]))
            some = (p > 0) | (q > 0)
            if 2 * some.sum() >= SUBSETS:
                best = max(best, float(((p == q) & some).sum() / some.sum()))
    return best


def _range_of(bounds: list[int]):
    """The number of the range that column k falls in."""
    return F.array_size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("k"))).cast("int") if bounds else F.lit(0)


def _ranges(docs: DataFrame, key, n: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Bounds of about n even ranges of the key, and (range, greatest key) of those that have rows."""
    ids = docs.select(key.alias("k"))
    found = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    bounds = sorted(set(found or []))
    return bounds, sorted((r.bin, r.k) for r in ids.groupBy(_range_of(bounds).alias("bin")).agg(F.max("k").alias("k")).collect())  # a row a range


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", idf: tuple[float, float] = IDF) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text is the text with its last third replaced by the beginning of its successor.
    """
    spark = docs.sparkSession
    lex = spark.sparkContext.broadcast(lexicon(docs, text_col, idf))
    kind = dict(docs.dtypes)[id_col]
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, tops = _ranges(docs, key, n)
    d = docs.select(F.col(id_col).alias("doc_id"), key.alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = d.withColumns({"bin": _range_of(bounds), "guest": F.lit(False)})
    # The first document of the range below (below the last: of the topmost) follows a range's last one.
    follows = [(b, tops[i - 1][1]) for i, (b, _) in enumerate(tops)]
    guests = spark.createDataFrame(follows or [(0, 0)], "bin int, k long")
    firsts = d.where(F.col("k").isin([k for _, k in tops] or [0])).groupBy("k").agg(F.max("text").alias("text"))
    guests = firsts.join(F.broadcast(guests), "k").select(F.lit(None).cast(kind).alias("doc_id"), "k", "text", "bin", F.lit(True).alias("guest"))
    dealt = own.unionByName(guests).repartitionById(n, "bin").sortWithinPartitions("bin", "guest", F.desc("k"), F.desc("text"))

    @lean
    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words, held = _Hashes(), lex.value, None
        for b in it:
            out: list[tuple] = []
            for id_, text, bin_, guest in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                text = text.as_py()
                print_ = fingerprint(text, words, known)
                if held is not None and held[2] == bin_:
                    old, was, _, first = held
                    m = len(was) // 3
                    edited = was[: len(was) - m] + text[:m]
                    changed = fingerprint(edited, words, known)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((old, len(was), sha, first, changed, likeness(first, changed), likeness(first, print_)))
                held = None if guest else (id_, text, bin_, print_)
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]), *(pa.array(c, pa.float64()) for c in cols[5:])], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(f, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
