"""rankspark: text retrieval, rank fusion and run evaluation as Spark DataFrame operators."""

__version__ = "0.1.0"
