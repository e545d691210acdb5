"""Operators over DataFrames of time ranges, events, relations and plans."""
