"""Strandline: session analytics for multi-sensor recordings, expressed in Spark DataFrames."""
