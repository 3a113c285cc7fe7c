"""Every query of this subpackage, and the SQL of those that SQL can express."""

from brindle.llm import queries_bpe, queries_covertree, queries_langid, queries_mixing, queries_quality, queries_rules, queries_sharding, queries_simhash, queries_training_order, queries_warc

_MODULES = (queries_bpe, queries_covertree, queries_langid, queries_mixing, queries_quality, queries_rules, queries_sharding, queries_simhash, queries_training_order, queries_warc)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
