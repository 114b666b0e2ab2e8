"""Operators over whole tables; each takes and returns DataFrames, all lazy."""
