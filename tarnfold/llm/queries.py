"""The ten queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from tarnfold.llm import ann, chat, langid, linededup, mixing, ngram_lm, packing, quality, simhash, toxicity
from tarnfold.llm.common import table

QUERIES = {
    "op1_quality_rules": lambda spark, d: quality.op1_quality_rules(table(spark, d, "documents")),
    "op2_chat_formatting": lambda spark, d: chat.op2_chat_formatting(spark, table(spark, d, "conversations")),
    "op3_source_mixing": lambda spark, d: mixing.op3_source_mixing(table(spark, d, "documents")),
    "op4_best_fit_packing": lambda spark, d: packing.op4_best_fit_packing(table(spark, d, "documents")),
    "op5_nearest_neighbours": lambda spark, d: ann.op5_nearest_neighbours(table(spark, d, "embeddings")),
    "op6_language_id": lambda spark, d: langid.op6_language_id(table(spark, d, "documents")),
    "op7_lm_scoring": lambda spark, d: ngram_lm.op7_lm_scoring(table(spark, d, "documents")),
    "op8_line_dedup": lambda spark, d: linededup.op8_line_dedup(table(spark, d, "documents")),
    "op9_toxicity": lambda spark, d: toxicity.op9_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_simhash": lambda spark, d: simhash.op10_simhash(table(spark, d, "documents")),
}

#: Packing, nearest neighbours, language identification, LM scoring, toxicity and SimHash have no SQL; tests hold them against brute force.
ORACLE_SQL = {
    "op1_quality_rules": quality.ORACLE,
    "op2_chat_formatting": chat.ORACLE,
    "op3_source_mixing": mixing.ORACLE,
    "op8_line_dedup": linededup.ORACLE,
}
