"""Operators: functions from DataFrames to a DataFrame. Frames are keyed by ``pid``; dates are parameters."""
