"""Toxicity by non-negative positive-unlabelled learning.

``train`` takes confirmed toxic documents and unlabelled ones, both bounded samples (``POSITIVES``, ``UNLABELLED``
rows; within a bound every row is taken), and fits a linear classifier in numpy on the presence of hashed words and
word beginnings. Its risk is prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]): unlabelled text stands
for the negatives once the share of positives in it, the class prior, is taken out; where that difference falls
below 0, the step goes against it. The prior is the share of toxic rows among the labels that may be learnt from.
``score`` applies the model to whole texts on all partitions; the model is one vector of ``DIM`` numbers.

Cases: null and empty texts score as texts without words; null label or id rows teach nothing; an id labelled twice is
toxic if one label says so; without confirmed examples every score is the prior; repeated rows each get their row; an empty
table gives an empty result; extra columns stay, but for one that has the name of ``score``'s result, which is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import CACHED_WORDS, give_back, lean, table

DIM = 1 << 20
POSITIVES = 6_000
UNLABELLED = 18_000
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float


def features(word: str) -> list[int]:
    """Places of a word: itself, and its first four and five letters."""
    return [zlib.crc32(f"{k}{word[:n]}".encode()) % DIM for k, n in (("w", None), ("4", 4), ("5", 5)) if n is None or len(word) > n]


def _places(text: str | None, known: dict[str, list[int]]) -> np.ndarray:
    if len(known) > CACHED_WORDS:
        known.clear()
    found: set[int] = set()
    for w in set(_WORDS.findall((text or "").lower())):
        f = known.get(w)
        if f is None:
            f = known[w] = features(w)
        found.update(f)
    return np.fromiter(found, np.int32, len(found))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(places: list[np.ndarray], positive: np.ndarray, prior: float, steps: int = 250, rate: float = 0.15, l2: float = 4e-4, least_df: int = 3, lift: float = 1.5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk, over features that are commoner in the positives."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    bias = float(np.log(prior / (1 - prior)))
    weights = np.zeros(DIM, np.float32)
    if not n_p or not n_u:
        return weights, bias
    # Document by document, so that only what is kept stands in one array (a document's places are distinct).
    df_p, df_u = np.zeros(DIM, np.int32), np.zeros(DIM, np.int32)
    for x, y in zip(places, positive, strict=True):
        (df_p if y else df_u)[x] += 1
    use = (df_p >= min(least_df, max(1, n_p // 4))) & (df_p / n_p >= lift * (df_u + 0.5) / n_u)
    number, d = np.cumsum(use) - 1, int(use.sum())
    kept = [number[x[use[x]]] for x in places]
    flat, doc = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(x) for x in kept])
    del kept
    theta, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    theta[d] = bias
    for t in range(1, steps + 1):
        z = np.bincount(doc, weights=theta[flat], minlength=len(places)) + theta[d]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # loss(+) = log(1 + e^-z), loss(-) = log(1 + e^z); derivatives s - 1 and s
        minus = np.logaddexp(0, z)
        negative = minus[~positive].mean() - prior * minus[positive].mean()
        g_plus = np.where(positive, prior * (s - 1) / n_p, 0.0)
        g_minus = np.where(positive, -prior * s / n_p, s / n_u)
        g = g_plus + g_minus if negative >= 0 else -g_minus
        grad = np.append(np.bincount(flat, weights=g[doc], minlength=d), g.sum())
        grad[:d] += l2 * theta[:d]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[use] = theta[:d]
    return weights, float(theta[d])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model from the labels of rows that aren't held out, and as many unlabelled texts as the bound allows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    n, n_p = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("_toxic") > 0).cast("int")), F.lit(0))).first()
    prior = min(max(n_p / n if n else 0.1, 1e-3), 0.5)
    draw = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(1_000_000)) / 1e6  # noqa: E731  even over [0, 1)
    positive = known.where((F.col("_toxic") > 0) & (draw(F.col("_id"), "p") < POSITIVES / max(n_p, 1))).select("_id", F.lit(True).alias("_positive"))
    total = docs.count()
    text = F.col(text_col)

    @F.pandas_udf("binary")
    @lean
    def places(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, list[int]] = {}
        for texts in it:
            yield pd.Series([_places(t, cache).tobytes() for t in texts])

    # At most POSITIVES ids (give or take the draw), so their side may be broadcast whatever the size of the labels.
    j = docs.select(F.col(id_col).alias("_doc"), text.alias("_text")).where(~held_out(F.col("_doc"))).join(F.broadcast(positive), F.col("_doc") == F.col("_id"), "left")
    rows = j.where(F.col("_positive") | (draw(F.col("_doc"), "u") < UNLABELLED / max(total, 1))).select(F.coalesce("_positive", F.lit(False)).alias("p"), (draw(F.col("_doc"), "u") < UNLABELLED / max(total, 1)).alias("u"), places("_text").alias("f")).toArrow()
    x = [np.frombuffer(b.as_buffer(), np.int32) for b in rows.column("f")]  # views of the table
    p, u = rows.column("p").to_numpy().astype(bool), rows.column("u").to_numpy().astype(bool)
    # A confirmed example that the unlabelled draw took as well stands on both sides: the draw is of all text.
    weights, bias = fit([a for a, y in zip(x, p) if y] + [a for a, y in zip(x, u) if y], np.r_[np.ones(p.sum(), bool), np.zeros(u.sum(), bool)], prior)
    del x, rows
    give_back()
    return Model(weights, bias, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability that each whole text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    @lean
    def apply(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        known: dict[str, tuple[int, ...]] = {}
        for texts in it:
            z = []
            for t in texts:
                if len(known) > CACHED_WORDS:
                    known.clear()
                found: set[int] = set()
                for w in set(_WORDS.findall((t or "").lower())):
                    f = known.get(w)
                    if f is None:
                        f = known[w] = tuple(i for i in features(w) if weights[i])
                    if f:
                        found.update(f)
                z.append(bias + float(sum(weights[i] for i in sorted(found))))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))

    return docs.withColumn(out, apply(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
