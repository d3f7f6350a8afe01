"""Operators over DataFrames; every one returns a lazy DataFrame unless it says that it writes."""
