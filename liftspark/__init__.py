"""Demand-signal analytics on Spark: engagement snapshots in, stock-out risk and alerts out."""
