"""Operators: functions from DataFrames and parameters to a DataFrame, with a declared result schema."""
