"""Compositions of operators: marts, the hourly run, training, and the query catalog."""
