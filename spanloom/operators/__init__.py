"""Operators: functions from DataFrames to DataFrames, and from columns to columns."""
