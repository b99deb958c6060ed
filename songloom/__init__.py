"""Analytics over media catalogs, time-coded text and listening logs, on Spark."""

__version__ = "0.1.0"
