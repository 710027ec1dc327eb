"""Every query of the library proper with the SQL that checks it.

Driver tables stand in for the domain's: lineitem for extracted properties, part for
materials, documents for paragraphs, events for arrival logs, labels for curated truth.
"""

from quarry.plans import query_joins, query_ordered, query_records, query_text

MODULES = (query_records, query_joins, query_text, query_ordered)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
