"""Lookups, scorers, fusion and history: DataFrame to DataFrame."""
