"""Column-to-column expressions; no function here triggers or plans anything by itself."""
