"""Operator families, one module each; every function takes and returns DataFrames."""
