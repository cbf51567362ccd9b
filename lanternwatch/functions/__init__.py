"""Column-level building blocks: patterns, checksums, spans."""
