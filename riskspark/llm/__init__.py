"""Training-data operators (WARC, dedup, decontamination, PII, packing, ...).

Nothing outside this subpackage imports it; ``catalog`` holds its registered
queries and their DuckDB statements.
"""
