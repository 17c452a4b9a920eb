"""Bulk scoring of marketing texts and engagement analytics on Spark DataFrames."""
