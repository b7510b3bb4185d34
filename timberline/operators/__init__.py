"""Parsing, tokenising and searching logs as DataFrames."""
