"""Analyst operators: DataFrame (+ column names) -> DataFrame."""
