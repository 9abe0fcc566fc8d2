"""Operators: functions from DataFrames to DataFrames. Default columns: key `location`, `date`, value `y`."""
