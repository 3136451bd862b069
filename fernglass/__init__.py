"""fernglass: a knowledge-base search and text-processing engine on Spark DataFrames."""
