"""Benchmarks read, runs scored, metrics computed in Spark."""
