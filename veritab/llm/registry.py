"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import ann, langid, licenses, minhash, mixing, packing, sharding, simhash, token_store, warc

MODULES = [ann, langid, mixing, token_store, warc, sharding, packing, licenses, simhash, minhash]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
