"""Trend analytics on Spark: what is growing unusually fast, and how good is the evidence."""
