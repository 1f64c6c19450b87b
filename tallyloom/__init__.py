"""Financial-statement analytics and document preparation on Spark DataFrames."""
