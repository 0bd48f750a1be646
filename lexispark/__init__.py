"""A document-corpus retrieval, preparation and evaluation engine on PySpark DataFrames."""
