"""workmill: work-tracking analytics as Spark jobs.

Every operator is a function from DataFrames to a DataFrame with an explicit
as-of time; nothing here runs an action unless its docstring says so.
"""
