"""Operators over sketches; each takes and returns DataFrames."""
