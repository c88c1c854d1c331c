"""Palimpsest: analytics over versioned knowledge graphs on Apache Spark.

Entities, observations and relationships are append-only, validity-stamped
tables; every operator is a function from DataFrames to DataFrames.
"""
