"""A data-profiling and data-purification engine on PySpark DataFrames."""
