import hashlib
import math
import re
import sys
from collections import Counter
from pathlib import Path

from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from test_jaccard import brute
from test_secrets import added, base

import corpus_pipeline
from palaver.llm import bpe, toxicity
from palaver.llm.common import table


def redacted(text):
    out, at = "", 0
    for a, _, b in sorted(base(text) + added(text)):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def mixed(docs, quality):
    """Copies by id: sources weigh 5, 2, 1 for 150 % of all words, none over twice its own."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in docs}
    sources = sorted({s for *_, s in docs})
    own = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    share = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    left, open_, goal = 1.5 * sum(own.values()), set(sources), {}
    while open_:
        level = left / sum(share[s] for s in open_)
        full = {s for s in open_ if level * share[s] >= 2 * own[s]}
        goal |= {s: 2.0 * own[s] for s in full} or {s: level * share[s] for s in open_}
        left -= sum(goal[s] for s in full)
        open_ = open_ - full if full else set()
    weight = {1: 2.0, 0: 0.5}
    key = lambda i: -math.log((int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight.get(quality.get(i), 1.0)
    copies = {}
    for s in sources:
        whole, upto = math.floor(goal[s] / own[s]) if own[s] else 0, 0
        for i in sorted((i for i, _, x in docs if x == s), key=key):
            upto += size[i]
            copies[i] = whole + (upto - size[i] / 2 <= goal[s] - whole * own[s])
    return copies


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels").select("doc_id", "toxic"))
    clean = [(r.doc_id, r.text, r.source) for r in toxicity.score(docs, model).where("score < 0.5").collect()]
    heads = {i for i, _, c in brute([(i, t) for i, t, _ in clean]) if i == c}
    kept = [(i, redacted(t), s) for i, t, s in clean if i in heads]
    quality = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    copies = mixed(kept, quality)
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    want = Counter()
    for i, t, s in kept:
        want[i, s, tuple(tok.encode(t, add_special_tokens=False).ids)] += copies[i]
    got = Counter((r.doc_id, r.source, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes


def test_empty_and_null_rows(spark):
    sf = "/root/testdata/sf0.001"
    schema = table(spark, sf, "documents").schema
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, 0), (2, "", None, None, 0), (3, "words that stay here for good", "en", "a", 29)]
    for d in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, sf).collect()
            assert name == "source_mixing" or len(out) == d.count()
