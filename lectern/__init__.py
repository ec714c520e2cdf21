"""lectern: timeline and evidence analytics on Spark.

Operators take DataFrames and return DataFrames; nothing here collects data to
the driver unless a docstring names the bound of what is collected.
"""
