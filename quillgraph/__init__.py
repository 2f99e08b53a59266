"""Record-graph analytics on Spark: typed queries, graph build, resolution and data quality as lazy DataFrame plans."""

__version__ = "0.1.0"
