"""Similarity search over very large collections of binary fingerprints, as Spark plans."""
