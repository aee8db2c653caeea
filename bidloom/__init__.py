"""bidloom: offer comparison and training-data preparation on PySpark DataFrames."""
