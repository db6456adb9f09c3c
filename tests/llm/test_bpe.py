import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palaver.llm import bpe

PATH = bpe.tokenizer_path()
TOK = Tokenizer.from_file(PATH)
CUT = bpe.word_splitter(PATH)
TEXTS = [
    None, "", " \t\n ", "Hello, WORLD it's 123 don't", "<|endoftext|>a<|startoftext|><|ENDOFTEXT|> <|endoftext|", "ΑΣΣΑΣ Σ éÉ İstanbul ŉ ª²½", "日本語 テスト 😀😀!", "a b c\x0bd\x0ce\x1cf\x85g​h\xad", "''s 'll!'s",
    "x" * 3000, "word " * 20_000, "ẹ̇ ḍ̇ ﬁ ǅ ẞ", "\r\n\r\nA\r", "ⅷ ٣ ೨ 𝟘 ǆ ʰ", "힣가",
]


def want(text):
    e = TOK.encode(text or "", add_special_tokens=False)
    return e.ids, TOK.decode(e.ids, skip_special_tokens=False)


def by_words(text):
    return [i for w in CUT(text) for i in TOK.encode(w, add_special_tokens=False).ids]


def test_words_of_fixed_texts():
    for t in TEXTS:
        assert by_words(t) == want(t)[0], t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250, codec="utf-8"), st.characters(codec="utf-8")), max_size=60))
def test_words_as_the_library(t):
    assert by_words(t) == want(t)[0]


def test_encode_and_decode(spark):
    d = spark.createDataFrame([(i, t, float(i)) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 3.0), (None, "x", None)], "doc_id long, text string, block double").repartition(3)
    rows = bpe.encode(d, PATH, keep=("doc_id", "block", "text"), outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"), block_chars=700).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        ids, text = want(r.text)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, text, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.block == (None if r.doc_id is None else float(r.doc_id))


def test_decode_is_a_join(spark):
    d = spark.createDataFrame([(i, want(t)[0]) for i, t in enumerate(TEXTS)] + [(99, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(d, PATH, ["doc_id"]).collect()}
    assert got == {i: want(t)[1] for i, t in enumerate(TEXTS)} | {99: ""}


def test_query(spark, sf):
    got = {r.doc_id: r for r in bpe.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids, text = want(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
