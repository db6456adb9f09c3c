"""BPE encoding and decoding over a table of distinct words.

A BPE tokenizer works on each word (pre-token) by itself, so every distinct word is encoded once: texts are split into
words, equal words meet by a shuffle and are encoded there by the tokenizers library, and the ids go back to
the positions that wait for them; ids become text by a join with the vocabulary.

Texts wait in blocks: a block is a run of documents within a partition, at most ``BLOCK_CHARS`` characters or one
document more. It sends each of its distinct words once, and keeps each document's sequence of word places, compressed. So
a word as frequent as it may be is a row a block, and no group exceeds a block. Words and sequences are two reads of
the texts; a block's name is a hash of its content, and rows that changed between the reads end the run
with an error instead of wrong ids.

Words are cut as the tokenizer file says (normalizer, then Split): texts of common Latin characters by an equal
regular expression, all others by the library. Strings of special tokens in a text are their ids, as in the library.

Cases: null and empty texts (and those of white space) give no ids and the empty string; repeated rows and ids are kept
row by row; an empty table gives an empty result; extra columns stay if named in ``keep``, under any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import give_back, lean, lean_group, steady, table

#: Characters of a block. Larger blocks send fewer words twice (disk), smaller ones take less of a worker's memory; the result is the same.
BLOCK_CHARS = 32_000_000
#: Documents whose word places are compressed together.
CHUNK = 256
#: Characters that need no library to be cut: they stay as they are under NFC.
_PLAIN = "\t\n\r" + "".join(chr(c) for r in (range(0x20, 0x7F), range(0xA1, 0x180), range(0x2010, 0x2028)) for c in r if c != 0xAD)
#: The Split pattern for which the equal expression below is made.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_splitter(path: str) -> Callable[[str | None], list[str]]:
    """A function from a text to the words that the tokenizer of this file encodes one by one."""
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    pattern = split["pattern"]["Regex"]
    special = [t["content"] for t in spec["added_tokens"]]
    at_special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
    # The file's normalizer alone, without its vocabulary.
    normalizer = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": {"a": 0}, "unk_token": "a"}})).normalizer
    cut = pre_tokenizers.Split(Regex(pattern), split["behavior"].lower(), invert=split["invert"])
    lowers = any(n["type"] == "Lowercase" for n in spec["normalizer"]["normalizers"])
    kinds = {n["type"] for n in spec["normalizer"]["normalizers"]} <= {"NFC", "Replace", "Lowercase"}
    fast = pattern == _SPLIT and kinds and lowers
    both = _PLAIN + "̇"  # which lower-casing a dotted capital I brings
    of = lambda k: "".join(re.escape(c) for c in both if unicodedata.category(c)[0] == k)
    letters, digits = of("L"), of("N")
    plain = re.compile(f"[{re.escape(_PLAIN)}]*").fullmatch
    words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^ \t\n\r{letters}{digits}]+").findall

    def pieces(text: str) -> list[str]:
        if fast and plain(text):
            return words(text.lower())
        return [w for w, _ in cut.pre_tokenize_str(normalizer.normalize_str(text))] if text else []

    def whole(text: str | None) -> list[str]:
        if not text:
            return []
        if "<" in text and any(s in text for s in special):
            return [w for part in at_special.split(text) for w in ([part] if part in special else pieces(part))]
        return pieces(text)

    return whole


def _planes(places: np.ndarray, zip_: zstandard.ZstdCompressor) -> bytes:
    """Word places, compressed byte plane by byte plane: most are small."""
    return zip_.compress(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _places(b: bytes, unzip: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unzip.decompress(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(it: Iterator[pa.RecordBatch], path: str, block_chars: int) -> Iterator[tuple[int, list[str], list[np.ndarray], list[pa.RecordBatch]]]:
    """Blocks of a partition's rows, text first: a name, the distinct words, each row's word places, the rows.

    Words stand by falling frequency. The name is a hash of the block's number and content, so that a task which runs again gives its
    blocks the same names, and one that meets other rows doesn't.
    """
    cut, places = word_splitter(path), defaultdict()
    places.default_factory = places.__len__
    docs: list[np.ndarray] = []
    rows: list[pa.RecordBatch] = []
    chars, part, done = 0, TaskContext.get().partitionId(), 0

    def block():
        words, at = list(places), np.concatenate(docs)
        n = np.bincount(at, minlength=len(words))
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        moved = np.split(rank[at], np.cumsum([len(d) for d in docs])[:-1])
        words = [words[i] for i in order.tolist()]
        h = xxhash.xxh3_64(f"{part}.{done}.{len(docs)}")
        h.update("\n".join(words).encode("utf-8", "surrogatepass"))
        h.update(at.tobytes())
        return h.intdigest() >> 1, words, moved, rows

    def others(batch: pa.RecordBatch, begin: int, end: int) -> pa.RecordBatch:
        """A copy of the columns but the text, so that no text waits for its block's end."""
        own = batch.select(batch.schema.names[1:])
        return own.take(pa.array(np.arange(begin, end))) if own.num_columns else own

    for batch in it:
        texts, start = batch.column(0), 0
        for i in range(len(texts)):
            text = texts[i].as_py()
            words = cut(text)
            docs.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
            chars += len(text or "") + 50
            if chars >= block_chars:
                rows.append(others(batch, start, i + 1))
                start = i + 1
                yield block()
                places.clear()
                docs, rows, chars, done = [], [], 0, done + 1
                give_back()
        if start < len(texts):
            rows.append(others(batch, start, len(texts)))
        del batch, texts
    if docs:
        yield block()


def block_words(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, block, place): each distinct word of each block of the texts (the first column)."""

    @lean
    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, _, _ in _blocks(it, path, block_chars):
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                yield pa.record_batch({"word": pa.array(part, pa.string()), "block": pa.array([block] * len(part), pa.int64()), "place": pa.array(range(i, i + len(part)), pa.int32())})

    return docs.mapInArrow(f, "word string, block bigint, place int")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """words with ids (binary, little-endian numbers of ``_width(path)``), each row's column word encoded once."""
    width = _width(path)

    @F.pandas_udf("binary")
    @lean
    def encode(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        for s in it:
            yield pd.Series([np.array(e.ids, width).tobytes() for e in t.encode_batch(list(s), add_special_tokens=False)])

    return words.withColumn("ids", encode("word"))


def _width(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): as many rows as the tokenizer has tokens."""
    return spark.createDataFrame(vocabulary_rows(path), "id int, piece string")


def vocabulary_rows(path: str) -> list[tuple[int, str]]:
    from tokenizers import Tokenizer

    return [(i, p) for p, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items()]


def decode(df: DataFrame, path: str, keys: Sequence[str], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """(keys, out) of rows of ids: each id meets its piece in a join, pieces are joined by a blank as a tokenizer without a decoder does.

    ``keys`` must name a row. The vocabulary is the only side that is broadcast: its size is that of the tokenizer.
    Null and empty arrays give the empty string, ids that the vocabulary lacks nothing.
    """
    rows = df.select(*keys, F.posexplode_outer(ids).alias("_pos", "_id"))
    joined = rows.join(F.broadcast(vocabulary(df.sparkSession, path)), F.col("_id") == F.col("id"), "left")
    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("_pos", "piece")))), lambda x: x["piece"])
    return joined.groupBy(*keys).agg(F.array_join(pieces, " ").alias(out))


def encode(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text", outputs: Sequence[str] = ("n_tokens", "ids", "decoded"), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs: ``keep`` and of n_tokens, ids, decoded, ids_sha256 and decoded_sha256 those in ``outputs``."""
    kinds = dict(docs.dtypes)
    names = [f"k{i}" for i in range(len(keep))]
    kept = [f"{n} {kinds[c]}" for n, c in zip(names, keep, strict=True)]
    d = steady(docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)]))
    width = _width(path)

    # Both reads are of the same columns, so that Spark deals out the same rows to both.
    # Every distinct word comes together with the places at which blocks wait for it, and is encoded there.
    waiting = block_words(d, path, block_chars).groupBy("word").agg(F.collect_list(F.struct("block", "place")).alias("at"))
    coded = encode_words(waiting, path).select("ids", F.explode("at").alias("at")).select("at.block", "at.place", "ids")

    @lean
    def sequences(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for block, _, docs, rows in _blocks(it, path, block_chars):
            # One document in CHUNK carries its chunk's places.
            packed = [_planes(np.concatenate(docs[i : i + CHUNK]), zip_) if i % CHUNK == 0 else None for i in range(len(docs))]
            t = pa.Table.from_batches(rows) if names else None
            own = {"block": pa.array([block] * len(docs), pa.int64()), "place": pa.array(range(len(docs)), pa.int32()), "n": pa.array([len(x) for x in docs], pa.int32()), "packed": pa.array(packed, pa.binary())}
            yield from pa.table({**({c: t.column(c) for c in names}), **own}).to_batches(max_chunksize=20_000)

    told = d.mapInArrow(sequences, ", ".join([*kept, "block bigint, place int, n int, packed binary"]))
    both = told.unionByName(coded, allowMissingColumns=True)

    types = {"n_tokens": ("bigint", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    schema = ", ".join([*kept, *(f"{o} {types[o][0]}" for o in outputs)])
    pieces = docs.sparkSession.sparkContext.broadcast([p for _, p in sorted(vocabulary_rows(path))])

    @lean_group
    def gather(t: pa.Table) -> pa.Table:
        unzip, piece = zstandard.ZstdDecompressor(), pieces.value
        is_doc = t.column("n").is_valid()
        docs, words = t.filter(is_doc).sort_by("place"), t.filter(pc.invert(is_doc)).sort_by("place")
        ids = words.column("ids").to_pylist()
        size = np.array([len(x) for x in ids], np.int64) // np.dtype(width).itemsize
        flat, at = np.frombuffer(b"".join(ids), width), np.cumsum(size) - size
        # The id-to-piece join, once for each word of the block.
        said = [piece[i] for i in flat.tolist()] if {"decoded", "decoded_sha256"} & {*outputs} else []
        text = [" ".join(said[a : a + k]) for a, k in zip(at.tolist(), size.tolist(), strict=True)] if said else []
        gaps = not all(text)
        out: dict[str, list] = {o: [] for o in outputs}
        chunk, begin = np.zeros(0, np.int64), 0
        for n, packed in zip(docs.column("n").to_pylist(), docs.column("packed").to_pylist(), strict=True):
            if packed is not None:
                chunk, begin = _places(packed, unzip), 0
            w = chunk[begin : begin + n]
            begin += n
            if n and int(w.max()) >= len(size):
                raise RuntimeError("a block lacks words: the rows of docs changed between two reads; give encode() a table that is written")
            k = size[w]
            ends = np.cumsum(k)
            total = int(ends[-1]) if n else 0
            own = flat[np.arange(total) + np.repeat(at[w] - (ends - k), k)].astype("<u4") if total else np.zeros(0, "<u4")
            parts = [text[i] for i in w.tolist()] if text else []
            whole = " ".join(filter(None, parts) if gaps else parts)
            for o, v in out.items():
                v.append(total if o == "n_tokens" else own.astype(np.int32) if o == "ids" else whole if o == "decoded" else hashlib.sha256(own.tobytes() if o == "ids_sha256" else whole.encode()).hexdigest())
        return pa.table([*(docs.column(c) for c in names), *(pa.array(out[o], types[o][1]) for o in outputs)], names=[*names, *outputs])

    done = both.groupBy("block").applyInArrow(gather, schema)
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *outputs)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
