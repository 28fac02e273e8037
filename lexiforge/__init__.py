"""Text analytics for building and judging typing correctors, on Spark DataFrames."""
