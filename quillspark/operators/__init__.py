"""Operator families; each is a set of functions from DataFrames to DataFrames."""
