"""Knowledge-graph analytics on Spark: plans, SPARQL, catalog and data-quality operators as DataFrames."""

__version__ = "0.1.0"
