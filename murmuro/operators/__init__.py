"""Operators on DataFrames; each takes and returns DataFrames and declares its plan with the DataFrame API."""
