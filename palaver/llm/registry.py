"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from palaver.llm import bpe, fingerprints, jaccard, lmscore, mixing, negatives, nndescent, runs, secrets, sharding, toolcalls, toxicity, urls

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_chat_tool_links": toolcalls.query,
    "op3_imatch": fingerprints.query,
    "op4_toxicity": toxicity.query,
    "op5_stupid_backoff": lmscore.query,
    "op6_nn_descent": nndescent.query,
    "op7_url_filter": urls.query,
    "op8_ngram_jaccard": jaccard.query,
    "op9_bpe": bpe.query,
    "op10_source_mixing": mixing.query,
    "op11_hash_tree_shards": sharding.query,
    "op12_periodic_runs": runs.query,
    "op13_hard_negatives": negatives.query,
}

ORACLES = {
    "op2_chat_tool_links": toolcalls.ORACLE_SQL,
    "op5_stupid_backoff": lmscore.ORACLE_SQL,
    "op6_nn_descent": nndescent.ORACLE_SQL,
    "op10_source_mixing": mixing.ORACLE_SQL,
    "op13_hard_negatives": negatives.ORACLE_SQL,
}
