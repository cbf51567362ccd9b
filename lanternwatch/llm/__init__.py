"""Training-data operators: decontamination, deduplication, extraction, scoring and mixing.

Nothing outside this subpackage imports it; ``queries`` holds the registered
jobs and their oracle SQL.
"""
