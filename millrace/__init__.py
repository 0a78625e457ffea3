"""Table and stream operators written as plain functions on Spark DataFrames."""
