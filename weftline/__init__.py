"""Record linkage and corpus processing on PySpark DataFrames."""
