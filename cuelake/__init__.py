"""Transcript and slide-evidence analytics on Spark DataFrames."""
