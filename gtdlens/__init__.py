"""Analytics for tournaments with a guaranteed prize, as Spark jobs."""

__version__ = "0.1.0"
