"""Relational and text operators; each takes DataFrames and returns DataFrames."""
