"""URL filters: a rule table first, then logistic regression on hashed character n-grams of host and path.

The model is trained in numpy from a small labelled table of URLs (``LABELLED``, some 770 invented hosts, unless another is given; at
most ``MOST_LABELLED`` rows are fitted). Rules name a host, which stands for all its subdomains too, and a path beginning; the longest
that fits decides. Distinct hosts meet the rules by their suffixes in a join, and pages meet their host's rules by host and
salt, so a host with a third of all pages is dealt over ``SALTS`` tasks. The only thing sent to all tasks is the weight vector of
``DIM`` numbers.

Cases: a null url or one without :// has an empty host and path, which no rule fits and the model judges as it does any string;
repeated pages each keep their row; of rules alike in host and path, block wins; an empty table gives an empty result; extra
columns stay in ``judge``, but for url_host, url_path, url_rule, url_score and url_verdict, which are replaced.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import CACHED_WORDS, lean, table

DIM = 1 << 16
GRAMS = (3, 4, 5)
SALTS = 32
MOST_LABELLED = 100_000
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_BAD = "casino bets poker slots jackpot bingo roulette pills viagra meds cialis steroids loans payday adult sex cams escort singles warez crack keygen spam seo backlinks ads popup track prize lottery replica diet".split()
_GOOD = "news times library museum weather physics history docs wiki garden recipes travel science kernel river school chess music data parliament field maps tides poetry health forest bridge choir rail archive census theatre".split()
_WITH = {1: "free cheap best win online buy hot fast top farm vip xxx x click discount instant".split(), 0: "open city daily county old north royal junior public the our free online east summer national".split()}
_PATHS = {1: ("bonus", "buy-now", "win", "offers"), 0: ("articles", "about", "2023", "notes")}


def _labelled(bad: int = 8, good: int = 16) -> tuple[tuple[str, int], ...]:
    """Invented URLs: each word with so many of its kind's modifiers, in two spellings; twice as many good ones, as most of the web is.

    Scheme, subdomain, top-level domain, language, number and ending are drawn by a checksum of the host, whatever the label.
    """
    out = []
    for y, words, n in ((1, _BAD, bad), (0, _GOOD, good)):
        for i, word in enumerate(words):
            for k in range(n):
                other = _WITH[y][(i + k) % len(_WITH[y])]
                host = (f"{other}-{word}", f"{word}{other}", f"{word}-{other}")[(i + k) % 3]
                draw = lambda of, s=host: of[zlib.crc32(f"{of}{s}".encode()) % len(of)]
                path = draw(("", "", f"/{_PATHS[y][k % 4]}"))
                out.append((f"{draw(('http', 'https'))}://{draw(('', 'www.', 'm.', 'blog.'))}{host}.example.{draw(('com', 'org', 'net'))}{path}/{draw(('en', 'de', 'fr', 'es'))}/{draw(range(9000))}{draw(('', '.html', '/'))}", y))
    return tuple(out)


#: (url, label): 1 is to be blocked.
LABELLED = _labelled()


def parts(url):
    """Columns host and path of a url column."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _split(url: str) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min([len(rest), *(i for i in map(rest.find, "/?#") if i >= 0)])
    tail = rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[: min([len(tail), *(i for i in map(tail.find, "?#") if i >= 0)])]


def grams(host: str, path: str, known: dict[str, int]) -> np.ndarray:
    """Places of the distinct n-grams of host and of path, which don't share places."""
    found = set()
    for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            for i in range(len(s) - n + 1):
                g = mark + s[i : i + n]
                if (k := known.get(g)) is None:
                    if len(known) > CACHED_WORDS:
                        known.clear()
                    k = known[g] = zlib.crc32(g.encode("utf-8", "surrogatepass")) % DIM
                found.add(k)
    return np.fromiter(sorted(found), np.int32, len(found))


def train(labelled: Sequence[tuple[str, int]] = LABELLED, steps: int = 300, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradient steps; each url's grams share a unit of length."""
    rows = [(grams(*_split(u), {}), y) for u, y in labelled[:MOST_LABELLED] if u is not None and y is not None]
    w, b = np.zeros(DIM), 0.0
    if not rows:
        return w, b
    flat = np.concatenate([g for g, _ in rows])
    doc = np.repeat(np.arange(len(rows)), [len(g) for g, _ in rows])
    x = np.repeat([1 / np.sqrt(max(1, len(g))) for g, _ in rows], [len(g) for g, _ in rows])
    y = np.array([v for _, v in rows], float)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(doc, weights=w[flat] * x, minlength=len(rows)) + b)))
        g = (p - y) / len(rows)
        w -= rate * len(GRAMS) * (np.bincount(flat, weights=g[doc] * x, minlength=DIM) * 10 + l2 * w)
        b -= rate * g.sum()
    return w, b


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED, url_col: str = "url") -> DataFrame:
    """pages with url_host, url_path, url_rule (null where none fits), url_score (of the model) and url_verdict."""
    spark = pages.sparkSession
    host, path = parts(F.col(url_col))
    p = pages.withColumns({"url_host": host, "url_path": path, "_salt": F.pmod(F.xxhash64(url_col), F.lit(SALTS)).cast("int")})
    shared = spark.sparkContext.broadcast(train(labelled))

    @F.pandas_udf("double")
    @lean
    def score(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        (w, b), known = shared.value, {}
        for hosts, paths in it:
            found = [grams(h, q, known) for h, q in zip(hosts, paths, strict=True)]
            yield pd.Series([1 / (1 + np.exp(-(w[g].sum() / np.sqrt(max(1, len(g))) + b))) for g in found], dtype=float)

    # Scored where pages are read, so that the join has no part in how the work is dealt.
    p = p.withColumn("url_score", score("url_host", "url_path"))
    table_ = spark.createDataFrame([(h, q, a, f"{h}{q}") for a, h, q in rules], "_suffix string, rule_path string, action string, rule string")
    labels = max((h.count(".") for _, h, _ in rules), default=0) + 1  # no suffix of more labels can be a rule's host
    names = F.split("url_host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda n: F.array_join(F.slice(names, -n, n), "."))
    hosts = p.select("url_host").distinct().select(F.col("url_host").alias("_host"), F.explode(suffix).alias("_suffix"))
    own = hosts.join(table_, "_suffix").groupBy("_host").agg(F.collect_list(F.struct(F.length("rule").alias("n"), F.length("_suffix").alias("m"), "action", "rule", "rule_path")).alias("_rules"))
    own = own.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    p = p.join(own, (F.col("url_host") == F.col("_host")) & (F.col("_salt") == F.col("_part")), "left")
    best = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("url_path"), r["rule_path"])))
    p = p.withColumn("_best", best)
    verdict = F.coalesce(F.col("_best.action"), F.when(F.col("url_score") >= 0.5, "block").otherwise("allow"))
    return p.withColumns({"url_rule": F.col("_best.rule"), "url_verdict": verdict}).drop("_salt", "_part", "_host", "_rules", "_best")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return j.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.col("url_score").alias("score"))
