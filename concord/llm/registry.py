"""Queries of the training-data operators and the SQL that states them, where SQL can."""

from __future__ import annotations

import corpus_pipeline
from concord.llm import ann, bpe, decontaminate, html_text, language, lexical, licenses, minhash, token_counts, toxicity, url_filters, warc, whitening

MODULES = [ann, minhash, licenses, toxicity, token_counts, html_text, decontaminate, url_filters, warc, bpe, lexical, whitening, language]
QUERIES = {"pipeline": corpus_pipeline.run} | {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
