"""Evidence analytics on Spark: operators, functions, plans, sources and streams over DataFrames."""
