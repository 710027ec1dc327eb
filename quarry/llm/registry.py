"""The queries of the corpus operators and the SQL that checks them."""

from quarry.llm import ann, language, license_scan, mixing, packing, pii, sharding, simhash, topk, urls

MODULES = (pii, sharding, language, packing, urls, mixing, ann, simhash, license_scan, topk)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
