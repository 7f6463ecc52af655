"""Near-duplicate image analytics on Spark: sources, kernels, joins, scoring, clustering, reports."""

__version__ = "0.1.0"
