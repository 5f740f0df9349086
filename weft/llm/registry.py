"""The training-data queries, one for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from weft.llm import bpe, collocations, exact_dedup, hard_negatives, packing, pii, simhash, suffix_tree, token_counts, token_files, topk, toxicity, warc
from weft.llm.common import table

QUERIES: dict = {
    "op1_warc": lambda spark, sf_dir: warc.round_trip(table(spark, sf_dir, "pages")),
    "op2_bpe": lambda spark, sf_dir: bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    "op3_suffix_tree": lambda spark, sf_dir: suffix_tree.scored(table(spark, sf_dir, "documents")),
    "op4_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_groups(table(spark, sf_dir, "documents")),
    "op5_pii": lambda spark, sf_dir: pii.span_digests(table(spark, sf_dir, "documents")),
    "op6_packing": lambda spark, sf_dir: packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False),
    "op7_topk": lambda spark, sf_dir: topk.top_k(table(spark, sf_dir, "embeddings")),
    "op8_simhash": lambda spark, sf_dir: simhash.near_groups(table(spark, sf_dir, "documents")),
    "op9_toxicity": lambda spark, sf_dir: toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op10_token_counts": lambda spark, sf_dir: token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
    "op11_hard_negatives": lambda spark, sf_dir: hard_negatives.mined(hard_negatives.noisy_labels(table(spark, sf_dir, "embeddings"))),
    "op12_token_files": lambda spark, sf_dir: token_files.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")),
    "op13_collocations": lambda spark, sf_dir: collocations.phrases(table(spark, sf_dir, "documents")),
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op7_topk": topk.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
