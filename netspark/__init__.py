"""Network-traffic analytics on PySpark DataFrames."""
