"""Tessella: a retrieval and corpus-analytics engine made of Spark plans."""
