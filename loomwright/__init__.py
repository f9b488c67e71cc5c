"""loomwright: a Spark-first engine for post-training data work."""

__version__ = "0.1.0"
