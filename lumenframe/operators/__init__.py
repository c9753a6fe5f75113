"""Operators: DataFrame (plus parameters) in, DataFrame out."""
