"""Provenance-first retrieval engine on Spark DataFrames."""
