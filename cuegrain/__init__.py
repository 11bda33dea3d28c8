"""Media-timeline, subtitle and text-encoding analytics on Spark DataFrames."""
