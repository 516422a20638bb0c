"""Operators on take-off records: every one takes and returns DataFrames keyed by project_id."""
