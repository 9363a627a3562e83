"""scholia: bibliographic search and collaboration analytics, expressed as Spark DataFrames."""
