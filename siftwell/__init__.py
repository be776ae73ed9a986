"""Siftwell: retrieval analytics over document collections, declared as Spark plans."""
