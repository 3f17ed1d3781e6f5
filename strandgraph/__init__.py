"""Spark-native operators for knowledge-augmented text datasets.

Every operator takes and returns DataFrames (or Columns) and stays lazy unless
its docstring says it materialises an intermediate table.
"""
