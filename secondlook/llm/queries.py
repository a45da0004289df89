"""The registered queries of this subpackage and their SQL, by name."""

import corpus_pipeline
from secondlook.llm import (
    byte_bpe,
    chosen_path,
    harmonic_packing,
    language,
    log_bilinear,
    max_score,
    order_min_hash,
    pivot_tables,
    skip_chain,
    tokenizer_spans,
    toxicity,
    url_filter,
    word_scan,
)

QUERIES = {}
ORACLES = {}
for _module in (
    max_score, toxicity, log_bilinear, language, chosen_path, harmonic_packing, url_filter, order_min_hash,
    byte_bpe, skip_chain, word_scan, tokenizer_spans, pivot_tables,
):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
