"""gleanframe: Spark-native processing of photo-curation tables and their training-data stages."""

__version__ = "0.1.0"
