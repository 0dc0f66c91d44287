"""lumenframe: reference-similarity analytics on PySpark DataFrames."""
