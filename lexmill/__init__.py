"""lexmill: a Spark-native text-to-knowledge engine (see README.md)."""
