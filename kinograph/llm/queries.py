"""The queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import importlib

#: Modules that each hold QUERIES and ORACLES.
MODULES = ("q_warc", "q_substring", "q_decontaminate", "q_toxicity", "q_simhash", "q_embedding", "q_token_counts", "q_packing", "q_chat", "q_suffix_tree", "q_vector_codes", "q_trie", "q_retrieval")


def queries() -> dict:
    """name -> callable(spark, sf_dir)."""
    import corpus_pipeline

    own = {k: v for name in MODULES for k, v in importlib.import_module(f"kinograph.llm.{name}").QUERIES.items()}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    """name -> DuckDB SQL."""
    return {k: v for name in MODULES for k, v in importlib.import_module(f"kinograph.llm.{name}").ORACLES.items()}
