"""Operators over tasks, items, graphs and rankings: functions from DataFrames to DataFrames."""
