"""quern: a Spark-native engine for indexing, searching and curating code and text corpora."""

__version__ = "0.1.0"
