"""All queries of this subpackage and their SQL."""

from . import bpe, fingerprints, jaccard_join, line_dedup, packing, pii, quality, sharding, toxicity, urls

_MODULES = (bpe, fingerprints, sharding, toxicity, line_dedup, urls, pii, quality, jaccard_join, packing)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
