"""Meeting-transcript analytics as Spark DataFrames."""
