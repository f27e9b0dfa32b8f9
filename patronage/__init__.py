"""Donor analytics operators for Spark DataFrames."""
