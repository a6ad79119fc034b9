"""corvine: a Spark-first engine for retrieval analytics over text corpora."""

__version__ = "0.1.0"
