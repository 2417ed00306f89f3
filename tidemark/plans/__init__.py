"""Statements with names resolved, and their DataFrames."""
