"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from quillon.llm import ann, bpe, chat, exact_dedup, langid, ngram_join, packing, pii, quality, secrets

MODULES = (ann, chat, secrets, quality, ngram_join, pii, exact_dedup, bpe, langid, packing)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    found = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
