"""Motifmill: exact sequence matching and corpus preparation on PySpark."""
