"""Operators of the exam platform: functions from DataFrames to DataFrames."""
