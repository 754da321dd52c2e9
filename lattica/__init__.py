"""lattica: typed property graphs and their evidence as PySpark DataFrames."""
