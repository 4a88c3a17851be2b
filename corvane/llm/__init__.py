"""Operators for preparing language-model training data at corpus scale.

Every operator takes and returns Spark DataFrames and runs as a handful of Spark
jobs.  Nothing outside this package imports it.
"""
