"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from tracewell.llm import bpe, media, phrases, pii, positional, quality, rules, secrets, simhash, sortmeans, toxicity, urls, warc

_MODULES = (simhash, secrets, toxicity, media, urls, quality, warc, bpe, pii, positional, rules, sortmeans, phrases)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
