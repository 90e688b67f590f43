"""fabula: Spark-native analytics for timed narrative data.

Operators are functions from DataFrames to DataFrames; nothing here runs an
action unless its docstring says so.
"""
