"""Table reads and writes, keyed upsert, and raw tables derived from the star schema."""
