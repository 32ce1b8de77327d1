"""Corpus preparation for training data: operators, their queries and SQL twins. Nothing outside imports this package."""

from . import decontam, exact, jaccard, language, lm, merkle, negatives, packing, tokenfile, tokens, toxicity, urls, warc

MODULES = (tokens, urls, jaccard, lm, exact, toxicity, language, decontam, warc, packing, tokenfile, negatives, merkle)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
