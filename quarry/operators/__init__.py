"""Relational operators: predicates, scores, joins, ordered scans, records."""
