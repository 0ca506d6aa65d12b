"""Operators: functions from DataFrames to DataFrames, by column names."""
