"""Secret scans: key patterns plus sliding-window entropy, in DataFrame functions only.

``scan`` finds, in every whole text, the spans of three base patterns (leftmost, not overlapping within a kind,
matches that are too short dropped) and adds spans whose characters look random: every run of one character class
is a candidate, a window of ``WINDOW`` characters slides over it, the counts of its characters are kept up
as one enters and one leaves, and Shannon's entropy follows from them step by step. Windows at or over the class's
threshold join into spans. Candidates that the allow-list fits add nothing; base spans it never touches.

Spans are in code points, end exclusive, ordered by start, then kind in the order of ``KINDS``.

Cases: null text counts as empty; no finding gives empty arrays, counts of 0 and the hash of ''; repeated rows
each give their row; a candidate of any length is cut in pieces that overlap by a window less one, so windows across cuts
count and memory stays at one piece; an empty table gives an empty result; extra columns stay as they are, but for base_spans and secret_spans, which ``scan``
replaces and ``redact`` drops.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # as AKIA[A-Z0-9]+ of 18 characters or more: a shorter run holds no longer one
HEX = r"[0-9a-f]{16,}"  # runs are maximal either way
KINDS = ("assign", "access", "hex", "hex_entropy", "base64_entropy")
#: Character class: candidates, alphabet (in either case for hex), least entropy in bits.
CLASSES = {
    "hex_entropy": (r"[0-9a-fA-F]", "0123456789abcdefABCDEF", 3.0),
    "base64_entropy": (r"[A-Za-z0-9+/_-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.7),
}
WINDOW = 20
PIECE = 4096
#: A candidate with one of these in it adds no span: words and paths, numbers, sample values, runs of the alphabet, UUIDs.
ALLOW = (
    r"^[A-Za-z+/_-]*$",
    r"^[0-9-]*$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?key",
    r"(?i)0123456789|abcdefghij",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _pattern_spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern: what lies between matches and the matches themselves, lengths summed up along the text."""
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x)).alias("hit"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x)).alias("value"),
    )
    found = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), _none().alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("at"),
            F.when(x["value"] >= least, F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + x["gap"] + x["hit"]).alias("end"))))).otherwise(a["out"]).alias("out"),
        ),
    )
    return F.when(text.rlike(pattern), found["out"]).otherwise(_none())


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the three base patterns, in order."""
    return F.array_sort(F.concat(_pattern_spans(text, ASSIGN, 0, 1, 12), _pattern_spans(text, ACCESS, 1), _pattern_spans(text, HEX, 2)))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once instead of wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _flagged(piece: Column, alphabet: str, least: float, window: int) -> Column:
    """array<struct<a, b>>: joined windows of a piece whose entropy reaches ``least``."""
    logs = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(window + 2)])  # c log2 c by count
    f = lambda c: F.element_at(logs, c + 1)
    codes = F.transform(F.split(piece, ""), lambda x: F.instr(F.lit(alphabet), x))  # places in the alphabet, from 1
    return _let(codes, lambda codes: _slide(codes, len(alphabet), f, least, window))


def _slide(codes: Column, n_alphabet: int, f, least: float, window: int) -> Column:
    code = lambda i: F.element_at(codes, i)
    zeros = F.array_repeat(F.lit(0), n_alphabet)
    first = F.aggregate(F.slice(codes, 1, window), zeros, lambda counts, y: F.transform(counts, lambda c, k: c + (k + 1 == y).cast("int")))
    start = _let(first, lambda c: F.struct(c.alias("counts"), F.aggregate(c, F.lit(0.0), lambda s, n: s + f(n)).alias("sum"), F.array().cast("array<struct<a:int,b:int>>").alias("out")))

    def step(a: Column, i: Column) -> Column:
        """Window i starts at character i (from 0); from the second on, character i - 1 has left and i + window - 1 has come."""
        gone, come = code(F.greatest(i, F.lit(1))), code(i + window)
        same = (i == 0) | (gone == come)
        n_gone, n_come = F.element_at(a["counts"], gone), F.element_at(a["counts"], come)
        counts = F.when(same, a["counts"]).otherwise(F.transform(a["counts"], lambda c, k: c - (k + 1 == gone).cast("int") + (k + 1 == come).cast("int")))
        total = F.when(same, a["sum"]).otherwise(a["sum"] - f(n_gone) + f(n_gone - 1) - f(n_come) + f(n_come + 1))
        high = log2(window) - total / window >= least - 1e-9
        tail = F.element_at(a["out"], -1)
        joins = (F.size(a["out"]) > 0) & (F.coalesce(tail["b"], F.lit(-1)) >= i)
        grown = F.concat(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.struct(tail["a"].alias("a"), (i + window).alias("b"))))
        out = F.when(~high, a["out"]).when(joins, grown).otherwise(F.concat(a["out"], F.array(F.struct(i.alias("a"), (i + window).alias("b")))))
        return F.struct(counts.alias("counts"), total.alias("sum"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - window), start, step)["out"]


def _candidate_spans(text: Column, kind: str, allow: Sequence[str], window: int) -> Column:
    chars, alphabet, least = CLASSES[kind]
    number = KINDS.index(kind)
    pattern = f"{chars}{{{window},}}"
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def allowed(hit: Column) -> Column:
        fits = F.lit(False)
        for a in allow:
            fits = fits | hit.rlike(a)
        # Runs of hex digits are judged by the hex class alone.
        return fits if kind == "hex_entropy" else fits | hit.rlike("^[0-9a-fA-F]*$")

    def spans(hit: Column, at: Column) -> Column:
        pieces = F.regexp_extract_all(hit, F.lit(rf"[\s\S]{{1,{PIECE}}}"), F.lit(0))
        ahead = _let(pieces, lambda p: F.transform(p, lambda x, k: F.concat(x, F.coalesce(F.substring(F.get(p, k + 1), 1, window - 1), F.lit("")))))
        found = F.flatten(F.transform(ahead, lambda x, k: F.when(F.length(x) >= window, F.transform(_flagged(x, alphabet, least, window), lambda w: F.struct((at + k * PIECE + w["a"]).alias("start"), F.lit(number).alias("kind"), (at + k * PIECE + w["b"]).alias("end")))).otherwise(_none())))
        # windows that meet across a cut join
        return F.aggregate(
            found,
            _none(),
            lambda a, w: F.when((F.size(a) > 0) & (F.coalesce(F.element_at(a, -1)["end"], F.lit(-1)) >= w["start"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), w["kind"].alias("kind"), w["end"].alias("end"))))).otherwise(F.concat(a, F.array(w))),
        )

    found = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), _none().alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull() | allowed(x["hit"]), a["out"]).otherwise(F.concat(a["out"], spans(x["hit"], a["at"] + x["gap"]))).alias("out"),
        ),
    )
    return F.when(text.rlike(pattern), found["out"]).otherwise(_none())


def scan(docs: DataFrame, text_col: str = "text", allow: Sequence[str] = ALLOW, window: int = WINDOW) -> DataFrame:
    """docs with base_spans and secret_spans: array<struct<start, kind, end>>, kind an index of KINDS; the latter hold the former."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("base_spans", base_spans(text))
    more = F.concat(*[_candidate_spans(text, k, allow, window) for k in CLASSES])
    return d.withColumn("secret_spans", F.array_sort(F.concat("base_spans", more)))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **how) -> DataFrame:
    """docs with every secret span in the text replaced by ``mark`` (spans that overlap by one); other texts are unchanged."""
    text = F.col(text_col)
    done = F.aggregate(
        F.col("secret_spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when((s["start"] < a["at"]), a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    s = scan(docs, text_col, **how)
    return s.withColumn(text_col, F.when(F.size("secret_spans") > 0, done).otherwise(text)).drop("base_spans", "secret_spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return s.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(as_text(F.col("base_spans")), 256).alias("base_sha256"), as_text(F.col("secret_spans")).alias("spans"),
    )
