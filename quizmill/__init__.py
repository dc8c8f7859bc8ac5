"""Question-bank and text-corpus analytics on Spark DataFrames."""
