"""Spark-native analytics for entity responses to a treatment.

Tables are long DataFrames keyed by (entity, condition, hour, feature); every
fold, model, replicate and parameter is a key column, never a Python loop.
"""
