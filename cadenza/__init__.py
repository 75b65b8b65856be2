"""Cadenza: ordered-signal and corpus analytics on PySpark DataFrames."""
