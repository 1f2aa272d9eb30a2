"""Relationship-intelligence operators on Spark: DataFrame in, DataFrame out."""
